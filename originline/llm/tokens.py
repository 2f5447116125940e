"""Token counts by a two-tier lookup on the map side.

A byte-pair encoder never merges across white space, so the tokens of a text are
the sum over its pre-tokens (runs of bytes between white space). The first tier
is a table of the lengths of frequent pre-tokens, broadcast to all workers; the
second is a cache each worker fills with the pre-tokens the first one misses.
Only a miss of both runs the encoder. No pre-token is ever shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from originline.llm.common import extended, prepare

_ENCODERS: dict[str, Tokenizer] = {}


def encoder(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once in a process."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Tokenizer.from_file(path)
    return _ENCODERS[path]


class Lengths(dict):
    """Pre-token (bytes) to its number of tokens; what is missing is encoded and kept.

    ``room`` bounds the cache: a full one is emptied and starts again from the
    frequent table. Pre-tokens over 64 bytes are not kept.
    """

    def __init__(self, path: str, frequent: dict[bytes, int], room: int) -> None:
        super().__init__(frequent)
        self.path, self.frequent, self.room = path, frequent, room

    def __missing__(self, word: bytes) -> int:
        found = encoder(self.path).encode(word.decode("utf-8"), add_special_tokens=False)
        n = len(found.ids)
        if len(word) <= 64:
            if len(self) >= self.room + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def frequent_lengths(
    docs: DataFrame, path: str, sample_rows: int = 512, per_task: int = 4096, entries: int = 32_768,
) -> dict[bytes, int]:
    """Lengths of the commonest pre-tokens of a bounded, hashed sample of about ``sample_rows`` texts.

    The table only saves time: a pre-token it lacks is encoded by the worker. Each
    task sends its ``per_task`` commonest pre-tokens of 64 bytes at most.
    """
    rows = docs.count()
    part = max(1, rows // sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(w for w in text.as_buffer().to_pybytes().split() if len(w) <= 64)
                if len(seen) > 16 * per_task:
                    seen = Counter(dict(seen.most_common(per_task)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
            ["word", "n"],
        )

    # Strings, not row ids, decide the sample: any table with a text has them.
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")
    total: Counter[bytes] = Counter()
    for row in picked.mapInArrow(count, "word binary, n long").toLocalIterator():
        total[bytes(row["word"])] += row["n"]
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    found = encoder(path).encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)
    return {w: len(x.ids) for w, x in zip(words, found, strict=True)}


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, room: int = 400_000, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``path`` names a tokenizer file present on every worker. A null text counts as
    empty (0 bytes, 0 tokens); special strings inside a text are handled as the
    tokenizer does by default; an empty table gives an empty result; repeated rows
    are counted each; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, table.value, room)
        get = lengths.__getitem__
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(batch.num_columns - 1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(raw))
                tokens.append(sum(map(get, raw.split())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)),
                 pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names,
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = [*keep, "n_bytes", "n_tokens", "over_limit"]
    return rows.mapInArrow(count, extended(rows.drop("_text"), "n_bytes long, n_tokens long, over_limit boolean"))
