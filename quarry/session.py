"""Session set-up and the shared working folder of a job."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_written: list[tuple[SparkSession, str]] = []
_local_root: str | None = None


def local_session(name: str = "quarry", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    On one machine the workers get its folder in PYTHONPATH; on a cluster a zip
    of the package is distributed once per SparkContext.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    sc.environment["PYTHONPATH"] = str(_PACKAGE.parent)
    if not sc.master.startswith("local"):
        target = Path(tempfile.mkdtemp()) / "quarry.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in _PACKAGE.rglob("*.py"):
                z.write(p, p.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(target))
    sc._quarry_shipped = True


def work_root(spark: SparkSession) -> str:
    """Folder shared by all executors: spark.checkpoint.dir, or a temporary one
    where that setting is absent on one machine. On a cluster without it this
    raises an error: executors would each write to a disk of their own."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(_remove_tree, _local_root)
    return f"file://{_local_root}"


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; who writes there removes it."""
    return f"{work_root(spark)}/quarry/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few to keep them busy, as a
    small table in one file is; larger inputs are left as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of keys that a plan may broadcast, after they were counted.
BROADCAST_ROWS = 200_000


def staged(df: DataFrame, label: str = "part", partition_by: tuple[str, ...] = (), tidy: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and return it as read back.

    Cuts the lineage, and what feeds two branches of a plan is computed once.
    The files outlive lost executors; ``release`` (or the end of the
    interpreter) removes them. tidy: shuffle files that the writing needed go
    at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, order: list[str], into: str, first: int = 0, path: str | None = None) -> DataFrame:
    """df with consecutive numbers from ``first`` in the given order. Rows are
    sorted over all partitions and written, to ``path`` (which the caller
    removes) or as ``staged`` does; the sizes of these parts, one number each,
    tell where each begins."""
    row = "_row"
    ordered = df.sort(*order).withColumn(row, F.monotonically_increasing_id())
    if path is None:
        written = staged(ordered, "numbered")
    else:
        ordered.write.parquet(path)
        written = df.sparkSession.read.schema(ordered.schema).parquet(path)
    part, inside = F.shiftrightunsigned(row, 33), F.col(row).bitwiseAND((1 << 33) - 1)
    at, offsets = first, []
    for r in written.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r.p, at))
        at += r.n
    starts = df.sparkSession.createDataFrame(offsets, "_p bigint, _first bigint")
    return written.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(into, F.col("_first") + inside).drop("_p", "_first", row)


def release(spark: SparkSession) -> None:
    """Remove everything that ``staged`` has written for this session."""
    keep = []
    for owner, path in _written:
        if owner is spark:
            remove(spark, path)
        else:
            keep.append((owner, path))
    _written[:] = keep


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, on whatever file system it is; one that is not there changes nothing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


@atexit.register
def _release_all() -> None:
    for owner, path in _written:
        try:
            if owner.sparkContext._jsc is not None:
                remove(owner, path)
        except Exception:  # the JVM may be gone already
            if path.startswith("file:"):
                _remove_tree(path.removeprefix("file:").replace("//", "/", 1))
    _written.clear()

