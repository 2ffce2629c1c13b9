"""Scans and sinks: driver tables, fixture panels, parquet/CSV round trips."""

from .tables import read_table, TABLES
from .fixtures import (panel_a, panel_b, months_c, PANEL_A_SQL, PANEL_B_SQL,
                       MONTHS_C_SQL, duckdb_sql)
from .sinks import write_layer, read_layer, write_csv

__all__ = ["read_table", "TABLES", "panel_a", "panel_b", "months_c",
           "PANEL_A_SQL", "PANEL_B_SQL", "MONTHS_C_SQL", "duckdb_sql",
           "write_layer", "read_layer", "write_csv"]
