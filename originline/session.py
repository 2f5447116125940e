"""Session settings shared by the library, the tests and the benchmark."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A temporary folder replaces it only under a local master, where there is one
    machine; any other session without the setting is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    shared_folder(spark)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("originline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Test tables are small and the windows CPU-bound: do not merge their few
        # shuffle partitions into one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        # Column expressions are built by the thousand; skip per-call stack capture.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _WRITTEN:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def stage(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    The result has no lineage to recompute, survives lost executors and keeps
    column pruning and filter pushdown for its readers.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_once(df: DataFrame, name: str = "stage") -> DataFrame:
    """:func:`stage`, for loops: the files of the write's own shuffles go with it.

    Otherwise they stay until the driver happens to collect its garbage. The result
    can be given to :func:`unstage`.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        path = new_folder(spark, name)
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the folders of frames made by :func:`stage_once`; neither they nor what derives from them is read again."""
    for df in frames:
        path = _FOLDERS.pop(df, None)
        if path is not None:
            discard(df.sparkSession, path)
            _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def freeze(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably and cut its lineage.

    Used where later steps must all see the same rows in the same place, for
    example after range partitioning, whose bounds come from a sample.
    """
    configure(df.sparkSession)
    return stage(df)


def width(spark: SparkSession) -> int:
    """Number of partitions a sized shuffle should produce."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
