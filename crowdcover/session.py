"""Sessions, cut points in a lineage, and frames kept for reuse."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[DataFrame] = []
_own_dirs: dict[str, str] = {}


def local_session(cores: int | str = 8, name: str = "crowdcover", **settings) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # recording the Python line of every expression takes longer than making it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    return _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="crowdcover-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here, and the
    planner's size estimate starts again from the real file size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan that gives fewer tasks than there are cores, spread over all of them. A table
    of one small file would otherwise be worked on by a single core, however much work follows.
    A table with files enough is left as it is: no shuffle is added there."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def keep(df: DataFrame) -> DataFrame:
    """Persist ``df`` for several uses; :func:`release` lets go of everything kept."""
    df = df.persist()
    _kept.append(df)
    return df


def release() -> None:
    while _kept:
        _kept.pop().unpersist()
