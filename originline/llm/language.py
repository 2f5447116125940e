"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable order. Its counts are
frozen after training, so the code length of a byte after a context is a fixed
number: at the longest context the tree knows, a seen byte costs
-log2(count / (total + distinct)); an unseen one first pays the escape
-log2(distinct / (total + distinct)) and is then coded by the next shorter
context, whose bytes already excluded share nothing. Below the empty context all
bytes are equally likely. A text belongs to the language that codes it shortest.

The trees of all languages are merged into one of the same shape: a row per
context, a column per byte, a vector of code lengths (one per language) in each
cell. Scoring a text walks the tree for all its bytes at once.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.llm.common import extended, prepare, text_bytes

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def normal_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of a batch; each run of other bytes than letters is one space.

    Every text gets a space before it and a 0 byte behind it, so that no context
    reaches from one text into the next.
    """
    text = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = text_bytes(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", text, "\x00", ""))))
    ends = offsets[1:] - 1
    data = np.where(_LETTER[data], data, np.uint8(32))
    data[ends] = 0
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[offsets]


@dataclasses.dataclass(frozen=True)
class Model:
    """The merged context trees: see :func:`build`."""

    languages: tuple[str, ...]
    symbols: np.ndarray  # 256: byte to column; the last column stands for a text's end
    child: np.ndarray  # contexts x columns: the context one byte longer, 0 if unknown
    cost: np.ndarray  # (contexts * columns) x languages: bits
    depth: int

    def bits(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
        """Code length of every text under every language, in chunks of bounded memory."""
        n, width = len(offsets) - 1, self.child.shape[1]
        total = np.zeros((n, len(self.languages)))
        text = np.repeat(np.arange(n), np.diff(offsets))
        child, end = self.child.ravel(), width - 1
        for start in range(0, len(data), chunk):
            low = max(0, start - self.depth)
            code = self.symbols[data[low : start + chunk]].astype(np.int64)
            # node[i]: longest known context that ends just before byte i (1 is the empty one).
            best = np.ones(len(code) + 1, np.int64)
            at = np.ones(len(code) + 1, np.int64)
            for _ in range(self.depth):
                longer = np.zeros_like(at)
                longer[1:] = child[at[:-1] * width + code]
                best = np.where(longer > 0, longer, best)
                at = longer
            skip = start - low
            cell = best[skip:-1] * width + code[skip:]
            own = text[start : start + chunk]
            live = code[skip:] != end
            cell, own = cell[live], own[live]
            if len(own) == 0:
                continue
            first = int(own[0])
            for k in range(len(self.languages)):
                sums = np.bincount(own - first, weights=self.cost[cell, k])
                total[first : first + len(sums), k] += sums
        return total


def build(
    grams: dict[tuple[str, bytes], int], depth: int, least: int, room: int,
) -> Model:
    """Trees from counts of byte strings of 1 to ``depth`` + 1 bytes per language.

    A context is kept if some language saw it ``least`` times; the commonest ones
    are kept while the cost table stays within ``room`` bytes.
    """
    languages = tuple(sorted({lang for lang, _ in grams}))
    used = sorted({s[0] for _, s in grams if len(s) == 1})
    width = len(used) + 2
    symbols = np.full(256, len(used), np.int32)
    for k, b in enumerate(used):
        symbols[b] = k
    symbols[0] = width - 1
    seen: dict[bytes, int] = {}
    after: dict[tuple[bytes, str], list[tuple[int, int]]] = {}
    for (lang, s), n in grams.items():
        if len(s) <= depth:
            seen[s] = max(seen.get(s, 0), n)
        after.setdefault((s[:-1], lang), []).append((int(symbols[s[-1]]), n))
    most = max(1, room // (width * 4 * max(1, len(languages))))
    kept = sorted((s for s, n in seen.items() if n >= least), key=lambda s: (-seen[s], s))[:most]
    # A suffix and a prefix of a context are at least as common as itself, so the
    # cut leaves a tree; ties at its edge are cleared by length.
    nodes, known = [b"", b""], {b"": 1}
    for s in sorted(kept, key=lambda s: (len(s), s)):
        if s[:-1] in known and s[1:] in known:
            known[s] = len(nodes)
            nodes.append(s)
    child = np.zeros((len(nodes), width), np.int32)
    cost = np.zeros((len(nodes), width, len(languages)))
    for lang_at, lang in enumerate(languages):
        chance = np.full((len(nodes), width), 1.0 / width)
        for s, k in known.items():
            parent = chance[known[s[1:]]] if s else np.full(width, 1.0 / width)
            counts = np.zeros(width)
            for symbol, n in after.get((s, lang), ()):
                counts[symbol] += n
            total, distinct = counts.sum(), np.count_nonzero(counts)
            if total == 0:
                chance[k] = parent
                continue
            unseen = counts == 0
            rest = parent[unseen].sum()
            row = counts / (total + distinct)
            if rest > 0:
                row[unseen] = distinct / (total + distinct) * parent[unseen] / rest
            chance[k] = row
        cost[:, :, lang_at] = -np.log2(chance)
    for s, k in known.items():
        if s:
            child[known[s[:-1]], symbols[s[-1]]] = k
    return Model(languages, symbols, child, cost.reshape(-1, len(languages)).astype(np.float32), depth)


def train(
    docs: DataFrame, depth: int = 4, rows_per_language: int = 1500, least: int = 12, room: int = 48 << 20,
    most_grams: int = 400_000,
) -> Model | None:
    """Fit the trees on rows with ``text`` and non-null ``lang``; None if there are none.

    Bounds of the fit: about ``rows_per_language`` rows of each language, drawn by
    a hash of the row's text, and the ``most_grams`` commonest byte strings.
    Counting runs on the executors.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(rows_per_language / n))])
    unit = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    rows = labelled.where(unit < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = normal_bytes(batch.column(1))
            owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
            for lang in sorted(set(langs)):
                mine = data[(langs == lang)[owner]].astype(np.uint64)
                for k in range(1, depth + 2):
                    if len(mine) < k:
                        break
                    value = np.zeros(len(mine) - k + 1, np.uint64)
                    whole = np.ones(len(value), bool)
                    for j in range(k):
                        part = mine[j : j + len(value)]
                        value = (value << np.uint64(8)) | part
                        whole &= part != 0
                    keys, n = np.unique(value[whole], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array([k] * len(keys), pa.int32()),
                         pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "k", "gram", "n"],
                    )

    counted = rows.mapInArrow(count, "lang string, k int, gram long, n long")
    top = (
        counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).where("n > 1")
        .orderBy(F.desc("n"), "k", "gram", "lang").limit(most_grams)
    )
    found = {(r["lang"], int(r["gram"]).to_bytes(r["k"], "big")): r["n"] for r in top.toLocalIterator()}
    if not found:
        return None
    return build(found, depth, least, room)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row, from its text alone.

    ``score`` is the share of the winner in the sum of 2^-bits over all languages.
    A null text, one without a letter, or a missing model gives ``und`` and 0. Equal
    code lengths give the language first in order. Texts are read whole; other
    columns are ignored; repeated rows each get their row.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = len(texts)
            pred, score = ["und"] * n, np.zeros(n)
            if frozen is not None and n:
                data, offsets = normal_bytes(texts)
                bits = frozen.bits(data, offsets)
                best = bits.argmin(axis=1)
                gap = bits - bits[np.arange(n), best][:, None]
                share = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)
                plain = np.add.reduceat((data >= 97) & (data <= 122), offsets[:-1])
                for i in range(n):
                    if plain[i] or has_letter(texts[i].as_py() or ""):
                        pred[i], score[i] = frozen.languages[best[i]], share[i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(pred, pa.string()), pa.array(score)],
                [*keep, "lang_pred", "score"],
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(predict, extended(rows.drop("_text"), "lang_pred string, score double"))
