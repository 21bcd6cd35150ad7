"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of this library is expected to run with.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("touchline")
    builder = builder.config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster sets it.

    Only a local master without that setting (tests) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="touchline-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_HELD: list[Callable[[], None]] = []


def on_release(done: Callable[[], None]) -> None:
    """Has ``done`` called when scratch is released, at the driver's end at the latest."""
    if not _HELD:
        atexit.register(release)
    _HELD.append(done)


def release() -> None:
    """Removes all scratch written so far. Plans that operators have returned may still read it, so call this when their results are taken;
    a driver that lives long would otherwise fill the shared folder."""
    while _HELD:
        _HELD.pop()()


def scratch(spark: SparkSession, name: str) -> str:
    """A path for files of this run in the shared folder, removed by ``release``."""
    path = f"{shared_dir(spark)}/touchline-{name}"
    on_release(lambda: remove(spark, path))
    return path


def materialise(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors: columnar and compressed, so
    a fraction of the bytes a row-wise checkpoint takes. ``release`` removes the folder;
    until then lazily built plans may still read it.
    """
    spark = df.sparkSession
    path = scratch(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already; the folder is scratch
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's shuffle setting, at least one a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)



#: More ranges than this don't balance better; the sample their bounds come from, which the driver sees, is bounded with them.
MOST_RANGES = 100_000


def pieces(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Ranges for a table whose ranges are held by a task one at a time: about ``each`` rows each, at least ``parallelism``."""
    return min(MOST_RANGES, max(parallelism(spark), -(-rows // each)))
