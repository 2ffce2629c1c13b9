import re

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "avg_roa" in df.columns


def test_catalogue_keys_named_after_inventory():
    for k in entry.queries():
        assert (k.split("_")[0][0] in "abcdefghij" or k.startswith("flagship")
                or re.match(r"op\d+_|pipeline$", k))
