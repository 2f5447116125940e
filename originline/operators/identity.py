"""Table identity: canonical row text, row digests and table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
NULL_TEXT = "\\N"


def canonical(name: str, kind: str) -> Column:
    """Canonical text of one cell."""
    c = F.col(name)
    if kind == "timestamp":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    elif kind == "timestamp_ntz":
        text = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    elif kind in ("double", "float"):
        text = F.when(~F.isnan(c), F.format_string("%.6f", c.cast("double")))
    elif kind == "boolean":
        text = F.when(c, "true").when(~c, "false")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))


def row_digests(df: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 of every row's canonical text, in declared column order."""
    line = F.concat_ws(SEPARATOR, *(canonical(n, k) for n, k in df.dtypes))
    return df.select(*key, F.sha2(line, 256).alias("digest"))


def fingerprint(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Order-independent identity of a table; repeated keys are an error.

    Two sums, of the leading and of the next 60 bits of the row digests, do not
    depend on the order. The table is hashed once: sums per key first, which also
    shows a repeated key, then over all keys.
    """
    first, second = (
        F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)
    )
    per_key = row_digests(df, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(first).alias("a"), F.sum(second).alias("b")
    )
    total = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("n").alias("most"),
        F.concat_ws("-", F.sum("a").cast("string"), F.sum("b").cast("string")).alias("fingerprint"),
    )
    unique = F.when(F.coalesce("most", F.lit(1)) == 1, F.col("fingerprint")).otherwise(
        F.raise_error(F.lit("the key does not identify the rows"))
    )
    return total.select(F.lit(name).alias("name"), "rows", unique.alias("fingerprint"))


def compare(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Tables whose recorded and recomputed identities differ or are one-sided."""
    a = recorded.select("name", F.col("fingerprint").alias("recorded"))
    b = live.select("name", F.col("fingerprint").alias("recomputed"))
    return a.join(b, "name", "full_outer").select(
        "name", "recorded", "recomputed",
        F.col("recorded").eqNullSafe(F.col("recomputed")).alias("same"),
    )
