"""Benchmark decontamination by SimHash of item-sized windows.

An item of w words is compared with every window of w words of a document, or with
the whole document if that has fewer words. Both are
sets of five-word shingles, weighted by their rarity among the distinct item texts, so that a
stock phrase of many items counts for little. The weights' signs add up to a
SimHash of 128 bits. Items are indexed by blocks of their fingerprint's bits: with
more blocks than half the radius, two fingerprints within the radius agree in some
block but for one bit, so looking up each block and its one-bit neighbours finds
all of them. The exact weighted similarity then decides.

Whole documents against longer items need no fingerprint: shared shingles are counted.

A window that holds no shingle of any item has similarity 0; such windows are left
out before they are hashed. That takes a table of the items' shingles, which is part
of the broadcast index. The index is bounded: a benchmark larger than ``BLOCK_WORDS``
words is handled in blocks of whole items, each of them against all documents.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from originline.llm.common import extended, mix, prepare, shingle_hashes, slices, text_bytes, word_hashes

BITS = 128
WIDTH = 5
#: Words of items in one broadcast index: about 24 bytes each.
BLOCK_WORDS = 1_000_000


def _signs(shingles: np.ndarray) -> np.ndarray:
    """128 signs of every shingle: +1 or -1."""
    with np.errstate(over="ignore"):
        raw = np.column_stack([mix(shingles ^ np.uint64(0xA5A5A5A5)), mix(shingles + np.uint64(0x51ED270B))])
    bits = np.unpackbits(np.ascontiguousarray(raw).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def simhash(signs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprint (16 bytes) of one weighted set."""
    return np.packbits((weights @ signs) > 1e-9)


@dataclasses.dataclass
class Index:
    """Items of one block: their shingles, weights, fingerprints and bit blocks."""

    ids: list
    words: np.ndarray  # per item: number of words
    known: np.ndarray  # sorted shingles of all items
    idf: np.ndarray  # their weights
    lengths: list[np.ndarray]  # per known shingle: word counts of the items that hold it
    sets: list[np.ndarray]  # per item: positions in ``known``
    owners: np.ndarray  # items by known shingle, and the bounds of each shingle's run
    runs: np.ndarray
    weight: np.ndarray  # per item: sum of weights
    uneven: np.ndarray  # per item: whether its prints may be further off than the radius; compared without
    prints: np.ndarray  # items x 16
    radius: int
    lookup: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]]  # by word count: a table per bit block

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item of ``length`` words) whose fingerprints are within the radius."""
        bits = np.unpackbits(prints, axis=1)
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high, keys, owners in self.lookup.get(length, ()):
            own = _number(bits[:, low:high])
            left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = right - left
            windows.append(np.repeat(np.arange(len(own)), n))
            items.append(owners[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        pair = np.unique(np.concatenate(windows) * len(self.ids) + np.concatenate(items))
        window, item = pair // max(len(self.ids), 1), pair % max(len(self.ids), 1)
        close = np.unpackbits(prints[window] ^ self.prints[item], axis=1).sum(axis=1) <= self.radius
        return window[close], item[close]


def _number(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64))


def build_index(ids: list, texts: list[str | None], radius: int = 40, repeated: tuple | None = None) -> Index:
    """Index of items; those without a word are left out. ``radius`` is in bits of 128.

    Sets of similarity 0.8 differ in 18 to 20 bits on average, give or take 4; 40 is
    five deviations above, and unrelated sets differ in 64, give or take 6. That holds
    for equal weights; items with a weight below 1 or a repeated shingle are compared
    without fingerprints. ``repeated`` has the shingles that several distinct texts of
    the whole benchmark hold, sorted, and by how many; without it these texts are all.
    """
    data, offsets = text_bytes(pc.utf8_lower(pa.array(texts, pa.string())))
    words, bounds = word_hashes(data, offsets)
    counts = np.diff(bounds)
    shingles, at = shingle_hashes(words, bounds, WIDTH)
    own = [shingles[at[i] : at[i + 1]] for i in range(len(ids))]
    keep = [i for i in range(len(ids)) if counts[i] > 0]
    sets = [np.unique(own[i]) for i in keep]
    first = np.unique([words[bounds[i] : bounds[i + 1]].tobytes() for i in keep], return_index=True)[1] if keep else []
    known = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64))
    if repeated is None:
        repeated = np.unique(np.concatenate([sets[k] for k in first]) if keep else known, return_counts=True)
    df = np.ones(len(known), np.int64)
    if len(repeated[0]):
        at_df = np.minimum(np.searchsorted(repeated[0], known), len(repeated[0]) - 1)
        df = np.where(repeated[0][at_df] == known, repeated[1][at_df], 1)
    idf = 1.0 / (1.0 + np.log(df))
    places = [np.searchsorted(known, s) for s in sets]
    prints = np.array(
        [simhash(_signs(own[i]), idf[np.searchsorted(known, own[i])]) for i in keep], np.uint8).reshape(len(keep), BITS // 8)
    held_at = np.concatenate(places) if places else np.zeros(0, np.int64)
    holders = np.repeat(np.arange(len(places)), [len(p) for p in places])[np.argsort(held_at, kind="stable")]
    runs = np.concatenate([[0], np.cumsum(np.bincount(held_at, minlength=len(known)))])
    lengths = counts[keep]
    held: list[set[int]] = [set() for _ in known]
    for k, place in enumerate(places):
        for p in place.tolist():
            held[p].add(int(lengths[k]))
    # More blocks than half the radius: some block then differs in one bit at most.
    edges = np.linspace(0, BITS, max(radius // 2 + 1, 4) + 1).astype(int).tolist()
    lookup: dict[int, list] = {}
    for length in np.unique(lengths).tolist():
        items = np.flatnonzero(lengths == length)
        bits = np.unpackbits(prints[items], axis=1)
        lookup[length] = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            key = _number(bits[:, low:high])
            keys = np.concatenate([key, *[key ^ (1 << j) for j in range(high - low)]])
            owners = np.tile(items, high - low + 1)
            order = np.argsort(keys, kind="stable")
            lookup[length].append((low, high, keys[order], owners[order]))
    return Index([ids[i] for i in keep], lengths, known, idf, [np.array(sorted(h), np.int64) for h in held], places, holders, runs,
                 np.array([idf[p].sum() for p in places]),
                 np.array([idf[p].min() < 1 or len(p) < len(own[i]) for i, p in zip(keep, places, strict=True)], bool),
                 prints, radius, lookup)


def _membership(index: Index, shingles: np.ndarray) -> np.ndarray:
    """Position of each shingle among the items' shingles, -1 if none has it."""
    if len(index.known) == 0:
        return np.full(len(shingles), -1, np.int64)
    at = np.searchsorted(index.known, shingles)
    at[at == len(index.known)] = 0
    return np.where(index.known[at] == shingles, at, -1)


class Filter:
    """A bitmap of the items' shingles, which answers most lookups with one read."""

    def __init__(self, index: Index, bits: int = 22) -> None:
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[(index.known >> self.shift).astype(np.int64)] = True

    def may(self, shingles: np.ndarray) -> np.ndarray:
        return self.map[(shingles >> self.shift).astype(np.int64)]


def _similarity(index: Index, item: int, shared: float, n_shared: int, n_inside: int) -> float:
    """Weighted similarity; a window's other shingles weigh like those of the item that they stand for."""
    size = len(index.sets[item])
    lost = (index.weight[item] - shared) / (size - n_shared) if n_shared < size else index.weight[item] / size
    return float(shared / (index.weight[item] + (n_inside - n_shared) * lost))


def _sharing(index: Index, held: np.ndarray, n_inside: int, right: np.ndarray) -> Iterator[tuple[int, float]]:
    """Those of the ``right`` items that hold one of the distinct positions ``held``, and their similarity."""
    pairs = np.concatenate([index.owners[index.runs[p] : index.runs[p + 1]] for p in held.tolist()])
    at = np.repeat(held, index.runs[held + 1] - index.runs[held])
    at, pairs = at[right[pairs]], pairs[right[pairs]]
    items, place, count = np.unique(pairs, return_inverse=True, return_counts=True)
    for item, shared, n in zip(items.tolist(), np.bincount(place, index.idf[at]).tolist(), count.tolist(), strict=True):
        yield item, _similarity(index, item, shared, n, n_inside)


def matches(index: Index, words: np.ndarray, least: float) -> list[tuple[int, float, int]]:
    """(item, similarity, first word) of the best window of a document for each item it contains."""
    n = len(words)
    best: dict[int, tuple[float, int]] = {}
    for width in sorted({min(WIDTH, w) for w in index.lookup}):
        shingles, _ = shingle_hashes(words, np.array([0, n]), width)
        place = _membership(index, shingles)
        anchors = np.flatnonzero(place >= 0)
        if len(anchors) == 0:
            continue
        weight = np.where(place >= 0, index.idf[np.maximum(place, 0)], 1.0)
        wanted: dict[int, list[int]] = {}
        for anchor in anchors.tolist():
            for length in index.lengths[place[anchor]].tolist():
                if min(WIDTH, length) == width and length <= n:
                    wanted.setdefault(length, []).append(anchor)
        for item, value in _longer(index, n, width, shingles, place):
            if value >= least - 1e-12 and value > best.get(item, (0.0, 0))[0]:
                best[item] = (value, 0)
        for length, near in wanted.items():
            per = length - width + 1
            starts = np.unique((np.array(near)[:, None] - np.arange(per)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + length <= n)]
            right = index.uneven & (index.words == length)
            for start in starts.tolist() if right.any() else ():
                inside = np.unique(shingles[start : start + per], return_index=True)[1] + start
                held = place[inside]
                if not (held >= 0).any():
                    continue
                for item, value in _sharing(index, held[held >= 0], len(inside), right):
                    if value >= least - 1e-12 and value > best.get(item, (0.0, 0))[0]:
                        best[item] = (value, start)
            for part, prints in _window_prints(shingles, weight, starts, per):
                for window, item in zip(*(x.tolist() for x in index.near(prints, length)), strict=True):
                    start = int(part[window])
                    inside = np.unique(shingles[start : start + per], return_index=True)[1] + start
                    held = place[inside]
                    both = np.intersect1d(held[held >= 0], index.sets[item], assume_unique=True)
                    value = _similarity(index, item, index.idf[both].sum(), len(both), len(inside))
                    if value >= least - 1e-12 and value > best.get(item, (0.0, 0))[0]:
                        best[item] = (value, start)
    return [(item, value, start) for item, (value, start) in sorted(best.items())]


def _longer(index: Index, n: int, width: int, shingles: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, float]]:
    """Items of more than ``n`` words that share a shingle with the whole document, and their similarity."""
    if n >= index.words.max():
        return
    inside = np.unique(shingles, return_index=True)[1]
    held = place[inside]
    held = held[held >= 0]
    right = (index.words > n) & (np.minimum(index.words, WIDTH) == width)
    yield from _sharing(index, held, len(inside), right)


def _window_prints(shingles, weight, starts, per, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and fingerprints of the windows of ``per`` shingles, as differences of running sums."""
    for group in np.split(starts, np.flatnonzero(np.diff(starts) > per) + 1):
        for at in range(0, len(group), block):
            part = group[at : at + block]
            low, high = int(part[0]), int(part[-1]) + per
            run = np.vstack([np.zeros(BITS), np.cumsum(_signs(shingles[low:high]) * weight[low:high, None], axis=0)])
            yield part, np.packbits(run[part - low + per] - run[part - low] > 1e-9, axis=1)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark cut into blocks of whole items of about ``block_words`` words."""
    sized = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(np.ceil(total / (6 * block_words))))
    return [sized.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def _held_shingles(items: DataFrame) -> DataFrame:
    """Distinct (item text, shingle) by their hashes; texts of the same words are one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(pc.utf8_lower(batch.column(0)))
            words, bounds = word_hashes(data, offsets)
            whole = [int(shingle_hashes(words[low:high], np.array([0, high - low]), max(high - low, 1))[0][:1].sum())
                     for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            shingles, at = shingle_hashes(words, bounds, WIDTH)
            owner = np.repeat(np.array(whole, np.uint64), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(shingles.view(np.int64))], ["whole", "shingle"])

    return items.select("text").mapInArrow(work, "whole long, shingle long").distinct()


def _index_of(block: DataFrame, radius: int, blocks: list[DataFrame]) -> Index:
    """Index of a block; how many distinct texts hold a shingle is counted over all blocks."""
    rows = sorted({(r["item_id"], r["text"]) for r in block.toLocalIterator()}, key=str)
    if len(blocks) == 1:
        return build_index([r[0] for r in rows], [r[1] for r in rows], radius)
    items = functools.reduce(DataFrame.unionByName, blocks)
    counts = _held_shingles(items).groupBy("shingle").count().where("count > 1")
    found = counts.join(_held_shingles(block).select("shingle"), "shingle", "left_semi").toArrow()
    keys = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return build_index([r[0] for r in rows], [r[1] for r in rows], radius, (keys[order], found["count"].to_numpy()[order]))


def _scan(batch_text: pa.Array, index: Index, quick: Filter, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of all matches of a batch."""
    widths = sorted({min(WIDTH, int(n)) for n in index.words})
    data, offsets = text_bytes(pc.utf8_lower(batch_text))
    for low, high in slices(data, offsets):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        words, bounds = word_hashes(part, own)
        hit = np.zeros(high - low, bool)
        for width in widths:
            shingles, at = shingle_hashes(words, bounds, width)
            found = np.flatnonzero(quick.may(shingles))
            found = found[_membership(index, shingles[found]) >= 0]
            hit[np.searchsorted(at, found, side="right") - 1] = True
        for row in np.flatnonzero(hit).tolist():
            mine = words[bounds[row] : bounds[row + 1]]
            for item, value, start in matches(index, mine, least):
                yield low + row, item, value, start, min(len(mine), int(index.words[item]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 40, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per document and benchmark item that it contains.

    Columns: ``doc_id``, ``item_id``, ``similarity`` (of the best window),
    ``start_word`` and ``n_words`` (of that window; a document shorter than the item is
    one window). Words are lower-cased runs between white space; an item of fewer than five words is one shingle. A null or empty text or
    item matches nothing; repeated items count once, repeated rows each; an empty
    table on either side gives an empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    kind = benchmark.schema["item_id"].dataType
    out = extended(rows.drop("_text"), "item_id string, similarity double, start_word long, n_words long")
    out["item_id"].dataType = kind
    parts = []
    blocks = item_blocks(benchmark, block_words)
    for block in blocks:
        shared = spark.sparkContext.broadcast(_index_of(block, radius, blocks))
        parts.append(rows.mapInArrow(_finder(shared, least, to_arrow_type(kind)), out))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _finder(shared, least: float, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        quick = Filter(index)
        for batch in batches:
            found = list(_scan(batch.column(1), index, quick, least))
            at = pa.array([f[0] for f in found], pa.int64())
            ids = pa.array([index.ids[f[1]] for f in found], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), ids, pa.array([f[2] for f in found], pa.float64()),
                 pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return work


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 40, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all their columns, that contain no benchmark item."""
    spark = prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def dropper(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            quick = Filter(index)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _scan(batch.column(at), index, quick, least):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return work

    blocks = item_blocks(benchmark, block_words)
    for block in blocks:
        docs = docs.mapInArrow(dropper(spark.sparkContext.broadcast(_index_of(block, radius, blocks))), docs.schema)
    return docs
