"""Session helpers: building a local session for tests/bench and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlens") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading ``spark.checkpoint.dir`` first.

    On a cluster that setting names a shared folder and is used as is; without
    it a local master (tests, bench) gets a fresh scratch folder, others raise.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame as a parquet table in the session's checkpoint folder
    and scan it back.

    Used between panel layers and imputation steps: a lost executor then
    recomputes from the last written table, later plans stay shallow, and
    downstream scans prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, most: int) -> DataFrame:
    """The frame dealt evenly to tasks of at most ``most`` of its ``rows``.

    Used before steps that cost much more per row than the row's bytes tell:
    Spark sizes its tasks by bytes and would give thousands of rows to one."""
    parts = -(-rows // most)
    return df.repartition(parts) if parts > 1 else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlens`` importable in the Python workers (needed by the
    ``mapInPandas`` operators): zip the package into the checkpoint folder
    once per SparkContext and register it with ``addPyFile``."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    target_dir = base.rstrip("/") + f"/pyfiles-{uuid.uuid4().hex}"
    if "://" in target_dir:           # non-local checkpoint store: stage on the driver
        target_dir = tempfile.mkdtemp(prefix="ledgerlens-py-")
    os.makedirs(target_dir, exist_ok=True)
    path = os.path.join(target_dir, "ledgerlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
