"""Readers and writers of the declared tables: Parquet, JDBC, CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originline.schemas import TABLES
from originline.session import configure, new_folder
from originline.sources import jdbc as database
from originline.sources.snapshots import SnapshotTable

# Fixed value: ISO-8601 with offset, so that a file round-trips to the same instant.
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster, removed when the driver ends."""
    configure(spark)
    return new_folder(spark, name)


def declared(name: str) -> tuple[T.StructType, tuple[str, ...]]:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {sorted(TABLES)}")
    return TABLES[name]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns in declared order and type; an undeclared column is refused."""
    schema, _ = declared(name)
    extra = sorted(set(df.columns) - set(schema.fieldNames()))
    if extra:
        raise ValueError(f"table {name} has no column(s) {extra}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


#: Tables of which single partitions are replaced, and by what.
PARTITIONED = {"predictions": ("track", "model")}


def snapshots(spark: SparkSession, name: str, path: str) -> SnapshotTable:
    """A declared table in snapshots under a path."""
    return SnapshotTable(spark, path, declared(name)[0], PARTITIONED.get(name, ()))


def read_table(
    spark: SparkSession, name: str, path: str | None = None, ordered: bool = True,
    jdbc: dict[str, str] | None = None, partitions: int = 8,
) -> DataFrame:
    """A whole declared table from snapshots, plain Parquet or a database.

    A database table (``jdbc`` with its ``dbtable``) is read by ranges of the last
    column of its key, one task each. Ordering by the primary key is for final
    consumers; it costs a range shuffle, so jobs that only aggregate or join leave it off.
    """
    schema, key = declared(name)
    if jdbc:
        raw = database.read(spark, jdbc, jdbc["dbtable"], f'"{key[-1]}"', partitions)
    elif SnapshotTable.is_one(spark, path):
        raw = snapshots(spark, name, path).read()
    else:
        raw = spark.read.parquet(path)
    df = raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    return df.orderBy(*key) if ordered else df


def overwrite_table(df: DataFrame, name: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> int:
    """Replace a table's contents in one step; returns the rows written.

    Readers, this job's own included, see the old rows until the new ones are all
    there, and keep them if the write fails.
    """
    rows = conform(df, name)
    if jdbc:
        return database.replace(rows, jdbc, jdbc["dbtable"])
    return snapshots(df.sparkSession, name, path).replace(rows)


def overwrite_predictions(df: DataFrame, track: str, model: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> None:
    """Replace one (track, model) of the shared predictions table, keep the others.

    In snapshots or a database in one step. Of a plain partitioned folder, dynamic
    partition overwrite touches only the partitions the frame holds.
    """
    rows = conform(df, "predictions")
    if jdbc:
        database.replace(rows, jdbc, jdbc["dbtable"], {"track": track, "model": model})
        return
    if SnapshotTable.is_one(df.sparkSession, path):
        snapshots(df.sparkSession, "predictions", path).replace_partition(rows, track=track, model=model)
        return
    stray = rows.filter(
        ~(F.col("track").eqNullSafe(track) & F.col("model").eqNullSafe(model))
    )
    if stray.limit(1).count():
        raise ValueError(f"rows name another track or model than {track}/{model}")
    configure(df.sparkSession)
    rows.write.mode("overwrite").partitionBy("track", "model").parquet(path)


def iso(df: DataFrame) -> DataFrame:
    """Timestamps as ISO-8601 text, everything else unchanged."""
    return df.select(*(
        F.date_format(n, ISO).alias(n) if k == "timestamp" else F.col(n) for n, k in df.dtypes
    ))


def export_csv(df: DataFrame, path: str) -> None:
    iso(df).write.mode("overwrite").option("header", True).csv(path)


def scan_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A declared table from CSV: no schema inference, ISO-8601 instants."""
    schema, _ = declared(name)
    return (
        spark.read.schema(schema).option("header", True).option("timestampFormat", ISO).csv(path)
    )


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object per line, keys in sorted order; a reader sees a codec by the files' names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path, compression=compression)


def read_jsonl(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
