"""Declared tables in a database: parallel reads by key ranges, replacement in one transaction."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text columns need a length where they are ordered or compared.
TEXT = "VARCHAR(255)"


def _options(jdbc: Mapping[str, str]) -> dict[str, str]:
    return {k: v for k, v in jdbc.items() if k not in ("dbtable", "query")}


def _literal(value) -> str:
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def key_bounds(spark: SparkSession, jdbc: Mapping[str, str], table: str, key: str, partitions: int) -> list:
    """Keys that cut the table into ranges of equal numbers of rows, ascending and distinct.

    The database finds them by its own order and index, one short query a bound; no
    other row leaves it, so text keys and skewed numbers are cut as evenly as any.
    """
    ask = lambda sql: spark.read.format("jdbc").options(**_options(jdbc), query=sql).load()
    n = int(ask(f"SELECT COUNT(*) AS n FROM {table}").first()[0])
    at = sorted({n * k // partitions for k in range(1, partitions)} - {0})
    found = []
    for offset in at:
        row = ask(f"SELECT {key} AS k FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} OFFSET {offset} ROWS FETCH NEXT 1 ROWS ONLY").first()
        if row is not None and row[0] not in found:
            found.append(row[0])
    return found


def ranges(key: str, bounds: Sequence) -> list[str]:
    """Conditions that every row fulfils one of; rows without a key are in the first."""
    if not bounds:
        return ["1 = 1"]
    cuts = [_literal(b) for b in bounds]
    middle = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(cuts, cuts[1:], strict=False)]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *middle, f"{key} >= {cuts[-1]}"]


def read(spark: SparkSession, jdbc: Mapping[str, str], table: str, key: str, partitions: int = 8) -> DataFrame:
    """A whole table, one task per range of its key.

    The tasks have transactions of their own: a table that changes during the read
    should be read at an isolation the database offers, or from a copy.
    """
    bounds = key_bounds(spark, jdbc, table, key, partitions)
    given = _options(jdbc)
    url = given.pop("url")
    return spark.read.jdbc(url, table, predicates=ranges(key, bounds), properties=given)


class _Transaction:
    """One connection of the driver, committed at the end or rolled back."""

    def __init__(self, spark: SparkSession, jdbc: Mapping[str, str]) -> None:
        jvm = spark._jvm
        if "driver" in jdbc:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(jdbc["driver"])
        properties = jvm.java.util.Properties()
        for name, value in _options(jdbc).items():
            if name not in ("url", "driver"):
                properties.setProperty(name, str(value))
        self.connection = jvm.java.sql.DriverManager.getConnection(jdbc["url"], properties)
        self.connection.setAutoCommit(False)

    def __enter__(self) -> _Transaction:
        return self

    def run(self, sql: str) -> int:
        statement = self.connection.createStatement()
        try:
            return statement.executeUpdate(sql)
        finally:
            statement.close()

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.connection.commit()
            else:
                self.connection.rollback()
        finally:
            self.connection.close()


def exists(spark: SparkSession, jdbc: Mapping[str, str], table: str) -> bool:
    with _Transaction(spark, jdbc) as t:
        found = t.connection.getMetaData().getTables(None, None, table.upper(), None)
        other = t.connection.getMetaData().getTables(None, None, table, None)
        return bool(found.next() or other.next())


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {TEXT}" for f in rows.schema.fields if f.dataType.simpleString() == "string")


def create(spark: SparkSession, jdbc: Mapping[str, str], table: str, like: DataFrame) -> None:
    """An empty table with the columns of a frame."""
    writer = like.limit(0).write.format("jdbc").options(**_options(jdbc), dbtable=table)
    if text := _columns(like):
        writer = writer.option("createTableColumnTypes", text)
    writer.mode("errorifexists").save()


def replace(rows: DataFrame, jdbc: Mapping[str, str], table: str, where: Mapping[str, str] | None = None) -> int:
    """Replace a table's rows, or those with the values ``where`` names; returns the rows written.

    The tasks fill a table beside it, in parallel. One transaction then deletes and
    inserts: readers see all of the old rows or all of the new ones, and a failed job
    leaves the old ones.
    """
    spark = rows.sparkSession
    if where:
        same = F.lit(True)
        for name, value in where.items():
            same = same & F.col(name).eqNullSafe(F.lit(value))
        if rows.filter(~same).limit(1).count():
            raise ValueError(f"rows name another {' or '.join(where)} than {'/'.join(map(str, where.values()))}")
    if not exists(spark, jdbc, table):
        create(spark, jdbc, table, rows)
    beside = f"{table}_{uuid.uuid4().hex[:12]}"
    create(spark, jdbc, beside, rows)
    try:
        rows.write.format("jdbc").options(**_options(jdbc), dbtable=beside).mode("append").save()
        names = ", ".join(f'"{c}"' for c in rows.columns)
        gone = " AND ".join(f'"{k}" = {_literal(v)}' for k, v in where.items()) if where else "1 = 1"
        with _Transaction(spark, jdbc) as t:
            t.run(f"DELETE FROM {table} WHERE {gone}")
            return t.run(f"INSERT INTO {table} ({names}) SELECT {names} FROM {beside}")
    finally:
        with _Transaction(spark, jdbc) as t:
            t.run(f"DROP TABLE {beside}")
