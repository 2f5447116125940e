"""Document fingerprints by a homomorphic multiset hash.

A paragraph is a line, cut again at sentence ends. Each is hashed to a wide vector:
16 numbers modulo 2^64, for equality, and 192 signs, kept as numbers modulo 2^16,
for likeness. A document's fingerprint is the sum of its paragraphs' vectors. So it
does not depend on their order, and a paragraph can be added or taken away without
the rest of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.llm.common import extended, prepare
from originline.session import width

WIDE, SIGNS = 16, 192
_PARAGRAPH = re.compile(r"[^\n.!?]*[\n.!?]+|[^\n.!?]+")


def paragraphs(text: str) -> list[str]:
    """Pieces between line and sentence ends, trimmed, without empty ones."""
    return [p for p in (m.strip() for m in _PARAGRAPH.findall(text)) if p]


def vector(pieces: Sequence[str], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the pieces' vectors: numbers modulo 2^64, and signs modulo 2^16."""
    wide, signs = np.zeros(WIDE, np.uint64), np.zeros(SIGNS, np.int64)
    for start in range(0, len(pieces), block):
        part = pieces[start : start + block]
        raw = np.frombuffer(
            b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * WIDE + SIGNS // 8) for p in part), np.uint8,
        ).reshape(len(part), -1)
        with np.errstate(over="ignore"):
            wide += np.ascontiguousarray(raw[:, : 8 * WIDE]).view("<u8").sum(axis=0, dtype=np.uint64)
        signs += 2 * np.unpackbits(raw[:, 8 * WIDE :], axis=1).sum(axis=0, dtype=np.int64) - len(part)
    return wide, signs


def add(a: tuple, b: tuple, sign: int = 1) -> tuple:
    """Insertion (``sign`` 1) or deletion (-1) of the paragraphs of ``b``."""
    with np.errstate(over="ignore"):
        return (a[0] + b[0] if sign > 0 else a[0] - b[0]), a[1] + sign * b[1]


def text_of(value: tuple) -> str:
    wide, signs = value
    return wide.astype("<u8").tobytes().hex() + (signs % 65536).astype("<u2").tobytes().hex()


def likeness(a: tuple, b: tuple) -> float:
    """1 for equal fingerprints; else the estimated share of paragraphs in common, below 1.

    From the signs: twice the inner product over the sum of squares, not below 0.
    """
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    squares = float(a[1] @ a[1] + b[1] @ b[1])
    if squares == 0:
        return 0.0
    return float(min(max(2.0 * float(a[1] @ b[1]) / squares, 0.0), 1.0 - 1e-9))


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by as much of the next one; and where that begins."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k], len(text) - k


def edited_vector(value: tuple, text: str, new: str, cut: int) -> tuple:
    """The edited text's fingerprint from the old one: drop and add what follows the cut.

    The last paragraph end before the cut is one in both texts.
    """
    ends = [m.end() for m in re.finditer(r"[\n.!?]+", text[max(0, cut - 4096) : cut])]
    low = max(0, cut - 4096)
    # A run of end marks that touches the cut may go on behind it.
    ends = [low + e for e in ends if low + e < cut]
    start = ends[-1] if ends else 0
    return add(add(value, vector(paragraphs(text[start:])), -1), vector(paragraphs(new[start:])))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. The next document is
    the next in order of doc_id (then text); a null doc_id comes last; the last
    row's next is the first. A null text is empty; one row is its own next; an
    empty table gives an empty result; other columns are ignored.

    Rows are dealt by ranges of doc_id. The first row of a range is copied to the
    range before it, the only row that range needs from elsewhere.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(4 * width(spark), n // 100_000)
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def part_of(doc_id):
        import pandas as pd

        bounds = shared.value
        known = doc_id.notna().to_numpy()
        out = np.full(len(doc_id), len(bounds), np.int32)
        out[known] = np.searchsorted(bounds, doc_id[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    dealt = rows.withColumn("part", part_of("doc_id"))
    heads = {r["part"]: r["head"] for r in rows.select("doc_id").withColumn("part", part_of("doc_id"))
             .groupBy("part").agg(F.min("doc_id").alias("head")).collect()}
    order = sorted(heads)
    # Part to the one before it, the first to the last; one row for each part.
    side = spark.createDataFrame(
        [(p, heads[p], order[i - 1]) for i, p in enumerate(order)], "part int, head long, before int")
    at = dealt.join(F.broadcast(side), "part")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("before").alias("part"), F.lit(True).alias("copy"))
    sent = at.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    sent = sent.select("doc_id", "text", "to.part", "to.copy")
    sorted_rows = sent.repartition("part").sortWithinPartitions(
        F.col("part"), F.col("copy"), F.col("doc_id").asc_nulls_last(), F.col("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, vector): the row whose next one is awaited
        closed = None  # the part whose copy has been met
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copy and closed == part:
                    continue  # more rows with the head's id
                now = vector(paragraphs(text))
                if held is not None:
                    out.append(_row(held, text, now))
                if copy:
                    held, closed = None, part
                else:
                    held = (doc_id, text, now)
            yield pa.RecordBatch.from_pylist(out, schema=target) if out else pa.RecordBatch.from_pylist([], schema=target)

    ddl = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    target = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return sorted_rows.mapInArrow(work, extended(rows.select(F.col("doc_id").cast("long")), ddl))


def _row(held: tuple, following: str, after: tuple) -> dict:
    doc_id, text, own = held
    new, cut = edited(text, following)
    changed = edited_vector(own, text, new, cut)
    return {
        "doc_id": doc_id, "n_chars": len(text),
        "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": text_of(own), "edited_fingerprint": text_of(changed),
        "near_edited": likeness(own, changed), "near_next": likeness(own, after),
    }
