"""Session helpers: building a session, cutting lineage, reading tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veilstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on; ``conf`` overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.redaction.string.regex": "(?i)key=[^,)]*",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only on a local master, as in tests, a fresh temporary
    folder is made where it is unset; elsewhere executors wouldn't share it, and that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="veilstone-")
    context.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later readers don't recompute it.

    A written table, unlike a local checkpoint, survives the loss of executors and keeps the
    outcome of nondeterministic inputs fixed for every reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: list[str] = []


def drop_cuts(spark: SparkSession) -> int:
    """Deletes the tables that :func:`cut` has written in this process; to be called when their results are stored."""
    n = len(_CUTS)
    while _CUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return n


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that :func:`cut` has written within it: a query is to be run and its result stored inside."""
    outer, _CUTS[:] = list(_CUTS), []
    try:
        yield
    finally:
        drop_cuts(spark)
        _CUTS[:] = outer


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; unchanged where the scan already gives them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that a table may have to be read to the driver as one of a fixed size.
FIXED_ROWS = 200_000


def fixed_table(df: DataFrame, most: int = FIXED_ROWS) -> list:
    """The rows of a table of a fixed size; an error if there are more than ``most``, so that it never grows unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that is read to the driver")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
