"""Session helpers: settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a written query go when it has ended, not when the driver's
#: garbage collector finds them.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", app: str = "tapeworks", work: str | None = None) -> SparkSession:
    """A local session for tests and benches. A cluster brings its own.  ``work``
    becomes spark.checkpoint.dir."""
    cores = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = (builder.config("spark.checkpoint.dir", work) if work else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; the setting is put back."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``; only when that is unset
    (tests) it lies in the warehouse folder, which executors share as well.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(work_root(df.sparkSession))
    return df.checkpoint(eager=True)


def work_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tapeworks_work"


def no_larger_than(df: DataFrame, source: DataFrame) -> DataFrame:
    """Record that ``df`` has at most the rows of ``source`` (a grouped or
    filtered form of it, or a join to unique keys).  Catalyst multiplies the
    sizes of both sides of a join, which says nothing about such a plan."""
    df._size_bound = size_estimate(source)
    return df


def counted_by(df: DataFrame, source: DataFrame) -> DataFrame:
    """Record that no key has more rows in ``df`` than in ``source``, which is
    cheaper to count (a scan in place of a grouped form of it)."""
    df._row_bound = source
    return df


def size_estimate(df: DataFrame) -> int:
    """Proven bound when one is recorded, else Catalyst's size estimate of the
    plan in bytes (no job is run)."""
    bound = getattr(df, "_size_bound", None)
    if bound is not None:
        return bound
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors can reach (below the checkpoint folder)."""
    import uuid

    return f"{work_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
