"""How document filters interact, audited by a stream with retractions.

The files of a table are read as available-now micro-batches. A document's failures of
the filters that look at it alone (A to D) are a mask. Whether it repeats a smaller
id's text (E) is known only for what has been read: the state holds, for every text,
the least id so far and the documents that bear it. All other documents of the text
count as repeats. When a smaller id arrives, the documents that held the text until
then are retracted from the counter of their part and mask and counted again as
repeats, so after every batch the counters are right for the files read so far.

State and counters are logs in the shared folder, one folder a batch, written over if
a batch is run again; the least id of a text is the least in its log. Joins with the
state are on text and id together, so a text of very many documents is spread.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from originline.llm.common import WORD_SPLIT, prepare
from originline.session import new_folder, stage

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
_REPEAT = 1 << FILTERS.index("E")
_STATE = "key binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"
_COUNT = "part string, mask int, good boolean, toxic boolean, n long"


def own_mask(text: Column, words: Column) -> Column:
    """The failures of A to D as bits; ``words`` are the words of the text."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def _described(rows: DataFrame) -> DataFrame:
    """Narrow rows: text key, id, part and mask, equal ones once with their number."""
    has = set(rows.columns)
    source = F.col("source").cast("string") if "source" in has else F.lit(None).cast("string")
    texts = rows.select("doc_id", F.coalesce(source, F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = texts.select("*", F.filter(F.split("text", WORD_SPLIT), lambda w: w != "").alias("words"))
    masked = split.select(
        F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("key"), "doc_id", "part",
        own_mask(F.col("text"), F.col("words")).cast("int").alias("mask"))
    return masked.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n"))


def _marks(labels: DataFrame) -> DataFrame:
    """Whether any label row calls a document good, or toxic."""
    has = set(labels.columns)
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)) if c in has else F.lit(False)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


class Audit:
    """The logs of one run and what every micro-batch adds to them."""

    def __init__(self, spark: SparkSession, labels: DataFrame) -> None:
        self.folder = new_folder(spark, "audit")
        self.marks = stage(_marks(labels), "marks")

    def path(self, log: str, batch: int) -> str:
        return f"{self.folder}/{log}/{batch:06d}"

    def earlier(self, spark: SparkSession, log: str, ddl: str, batch: int) -> DataFrame:
        """What the batches before this one wrote to a log."""
        paths = [self.path(log, b) for b in range(batch)]
        return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Add one micro-batch to the state and to the counters."""
        spark = batch.sparkSession
        marks = spark.read.schema(self.marks.schema).parquet(*self.marks.inputFiles())
        rows = stage(_described(batch), "described")
        named = rows.where("doc_id is not null").join(marks, "doc_id", "left").select(
            "key", "doc_id", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n")
        named = stage(named, "named")
        low = named.groupBy("key").agg(F.min("doc_id").alias("low"))
        state = self.earlier(spark, "state", _STATE, number)
        old = state.join(low, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("before"))
        lows = stage(low.join(old, "key", "left"), "lows")
        first = F.col("before").isNull()
        # The documents that bear the least id of their text, as of now.
        holders = named.join(
            lows.where(first | (F.col("low") <= F.col("before"))).select("key", F.col("low").alias("doc_id")), ["key", "doc_id"])
        holders.select("key", "doc_id", "part", "mask", "good", "toxic", "n").write.mode("overwrite").parquet(self.path("state", number))
        holders = spark.read.schema(_STATE).parquet(self.path("state", number))
        # Those that bore it until now.
        gone = state.join(
            lows.where(F.col("low") < F.col("before")).select("key", F.col("before").alias("doc_id")), ["key", "doc_id"])
        repeat = F.col("mask").bitwiseOR(F.lit(_REPEAT)).alias("mask")
        part = lambda frame, mask, n: frame.select("part", mask, "good", "toxic", n.alias("n"))
        same, n = F.col("mask"), F.col("n")
        nameless = rows.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
        changes = (
            part(named, repeat, n).unionByName(part(holders, repeat, -n)).unionByName(part(holders, same, n))
            .unionByName(part(gone, same, -n)).unionByName(part(gone, repeat, n)).unionByName(nameless))
        summed = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")
        summed.write.mode("overwrite").parquet(self.path("counts", number))

    def counters(self, spark: SparkSession, batches: int) -> DataFrame:
        """Documents by part, mask and marks, after some batches."""
        every = self.earlier(spark, "counts", _COUNT, batches)
        return every.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders() -> list[str]:
    return ["".join(o) for o in itertools.permutations(FILTERS)]


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the filter) of all orders."""
    out = []
    for order in orders():
        before = 0
        for step, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append((order, step + 1, before, bit))
            before |= bit
    return out


def interactions(counters: DataFrame) -> DataFrame:
    """The report of every part, order and step from documents by part, mask and marks."""
    at = lambda k, also: F.coalesce(F.sum(F.when((F.col("mask") == k) & also, F.col("n"))), F.lit(0))
    cells = [F.array(*[at(k, also) for k in range(MASKS)]).alias(name)
             for name, also in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    parts = counters.groupBy("part").agg(*cells)
    steps = _steps()
    masks = np.arange(MASKS)
    before, bit = (np.array([s[k] for s in steps])[:, None] for k in (2, 3))
    kept = ((masks & (before | bit)) == 0).astype(np.int64)
    here = ((masks & before) == 0) & ((masks & bit) != 0)
    again = ((masks & before) != 0) & ((masks & bit) != 0)
    alone = (masks == bit).astype(np.int64)
    letter = np.array([s[3] for s in steps])
    shared = np.stack([here[letter == 1 << k].sum(axis=0) for k in range(len(FILTERS))])[np.log2(letter).astype(int)]
    tables = [(kept, "n"), (here.astype(np.int64), "n"), (again.astype(np.int64), "n"), (alone, "n"),
              (here.astype(np.int64), "good"), (here.astype(np.int64), "toxic"), (shared, "n")]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    order, number = pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                counts = {c: batch.column(k + 1)[row].values.to_numpy() for k, c in enumerate(("n", "good", "toxic"))}
                part = pa.repeat(batch.column(0)[row].as_py(), len(steps))
                yield pa.RecordBatch.from_arrays(
                    [part, order, number, *[pa.array(t @ counts[c]) for t, c in tables]], ["part", "filter_order", "step", *names])

    return parts.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """Five filters on the documents under ``path``: one row per part, order of the filters and step.

    ``path`` names Parquet files, read in about ``batches`` micro-batches of whole
    files. A document fails A with under 200 words, B if fewer than half of its words
    are distinct, C if over 2 % of its code points are A-Z, D if it holds one of
    ``#$%&*|``, and E if a smaller doc_id has the same text. Words are runs of other
    than ``\\x20\\x09-\\x0D``. ``part`` is the source, empty for null. A filter removes
    what fails it and was not removed before; see :func:`interactions` for the columns.

    A null text is the empty one. A null doc_id has no smaller one, is smaller than
    none, and has no labels; rows of one doc_id and text do not repeat each other. Of several labels of
    a document any that says 1 counts. Without rows the report is empty; other
    columns are ignored; texts are read whole and told apart by 128 bits of SHA-256.
    """
    prepare(spark)
    files = spark.read.parquet(path)
    run = Audit(spark, labels)
    done: list[int] = []

    def absorb(batch: DataFrame, number: int) -> None:
        run.absorb(batch, number)
        done.append(number)

    n_files = len(files.inputFiles())
    if n_files:
        source = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", max(1, math.ceil(n_files / batches)))
        # A stream takes a single file by a pattern only; this one matches the path itself.
        bare = path.rstrip("/")
        stream = source.parquet(f"{bare[:-1]}[{bare[-1]}]")
        query = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", new_folder(spark, "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    return interactions(run.counters(spark, max(done, default=-1) + 1))


ORACLE_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
masked AS (
  SELECT doc_id, part,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM worded),
marked AS (
  SELECT m.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM masked m LEFT JOIN (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM marked GROUP BY 1, 2),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step]::INTEGER AS bit,
    coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM orders, range(1, 6) u(step)),
told AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM told
"""
