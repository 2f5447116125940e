"""Edge cases that every training-data operator must take: one small table."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog and runs far away into the dark green wood"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for columns of their own.
    *[T.StructField(n, T.StringType()) for n in ("size", "score", "shard", "slot", "node", "n", "words", "copies", "part", "item_id", "_copies", "_row", "_all", "_plan", "_key", "place", "range", "_id", "_text", "sig")],
])

ROWS = [
    (1, PLAIN, "en", "a", 80),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \n\t ", "en", None, 4),
    (5, "123 456 !! 789", "fr", "b", 14),
    (6, PLAIN, "en", "c", 80),
    (6, PLAIN, "en", "c", 80),
    (None, "A text without any id stands here alone", None, None, None),
    (7, LONG, "de", "a", len(LONG)),
    (8, "Été çà et là, où naît l'œuvre 😀 \x1c\x00 fin", "fr", "c", 30),
    (9, "two words", "en", "a", 9),
]


def table(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, *(["x"] * 20)) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
