"""Near-duplicate vectors by an inverted multi-index.

The halves of all unit vectors are quantised by two codebooks, fitted one by one; a
vector's cell is its pair of nearest codewords, so k codewords a half make a grid of
k * k cells. A vector looks for its links in the cells nearest to it, in the order of
the summed distances of its halves to their codewords (multi-sequence traversal), and
stops where the wanted share of links lies behind it. How far that is comes from the
fit: sampled vectors turned by just the angle that still links, and the linked pairs
of the sample. Whatever meets in a cell is compared by exact cosines.

Equal vectors are one node with a weight. A pair in two cells is looked for from the
lower cell only, one inside a cell once, so every link is counted once for both ends.
A cell beyond ``BLOCK`` rows is cut into salted blocks, and pairs of blocks are
compared; a task returns counts and a spanning forest of what it has seen, never pairs.
"""

from __future__ import annotations

import dataclasses
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.llm.common import draw, extended, prepare
from originline.llm.components import components
from originline.session import stage

#: Rows of a cell on one side of a comparison; rows of one product of matrices.
BLOCK, TILE = 4096, 512


@dataclasses.dataclass(frozen=True)
class Codebooks:
    """Codewords of both halves, and how far behind the nearest cell a traversal goes."""

    left: np.ndarray
    right: np.ndarray
    reach: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of unit vectors to all codewords."""
        cut = self.left.shape[1]
        return _squared(unit[:, :cut], self.left), _squared(unit[:, cut:], self.right)


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ words.T) + (words * words).sum(axis=1)[None], 0.0)


def nearest_cells(left: np.ndarray, right: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells of the grid in the order of their summed distances, as far as ``reach`` behind the first.

    The sorted codewords of both halves are two sequences; the next cell is the least
    of those whose neighbours before it in either sequence were visited.
    """
    by_left, by_right = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    a, b = left[by_left].tolist(), right[by_right].tolist()
    last = a[0] + b[0] + reach
    heap, met = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > last:
            return
        yield by_left[i], by_right[j]
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in met:
                met.add((k, m))
                heapq.heappush(heap, (a[k] + b[m], k, m))


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a batch, all of ``size`` finite numbers and not zero, at length one in doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct rows of ``x``; a codeword without rows stays where it is."""
    words = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([np.argmin(_squared(x[i : i + 4096], words), axis=1) for i in range(0, len(x), 4096)])
        held = np.bincount(of, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, of, x)
        words = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], words)
    return words


def codewords(n: int) -> int:
    """Codewords of a half for ``n`` vectors: n^0.28, so cells and visits both grow slowly."""
    return int(np.clip(round(n**0.28), 2, 1024))


def fit(sample: np.ndarray, k: int, least: float, target: float, seed: int = 7) -> Codebooks:
    """Codebooks from sampled unit vectors, and the reach that finds ``target`` of all links.

    Links are taken as hard as they come: every sampled vector turned by a random
    direction to a cosine of ``least``. The linked pairs among the sample are a second
    witness; the larger reach counts.
    """
    rng = np.random.default_rng(seed)
    cut = max(sample.shape[1] // 2, 1)
    left = _k_means(sample[:, :cut], k, rng)
    right = _k_means(sample[:, cut:], k, rng) if sample.shape[1] > 1 else np.zeros((1, 0))
    books = Codebooks(left, right, 0.0)
    some = sample[rng.permutation(len(sample))[:4096]]
    side = rng.normal(size=some.shape)
    side -= (side * some).sum(axis=1, keepdims=True) * some
    side /= np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), 1e-12)
    turned = least * some + np.sqrt(max(0.0, 1.0 - least * least)) * side
    reach = [np.quantile(_excess(books, some, turned), target)]
    a, b = [], []
    for i in range(0, len(some), TILE):
        p, q = np.nonzero(some[i : i + TILE] @ some.T >= least)
        apart = p + i != q
        a.append(p[apart] + i)
        b.append(q[apart])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        reach.append(np.quantile(_excess(books, some[a], some[b]), target))
    return dataclasses.replace(books, reach=float(max(reach)) + 1e-9)


def _excess(books: Codebooks, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far behind its own nearest cell, seen from x, the cell of y lies."""
    out = []
    for i in range(0, len(x), 4096):
        (xl, xr), (yl, yr) = books.distances(x[i : i + 4096]), books.distances(y[i : i + 4096])
        rows = np.arange(len(xl))
        out.append(xl[rows, yl.argmin(axis=1)] + xr[rows, yr.argmin(axis=1)] - xl.min(axis=1) - xr.min(axis=1))
    return np.concatenate(out)


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: components, all finite, not all zero."""
    huge = F.lit(float("inf"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (c < huge) & (c > -huge))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0), F.lit(False))


def _placed(nodes: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """``node``, ``w``, ``v``, its ``cell`` and the higher cells it visits."""
    shared = nodes.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        k = len(books.right)
        for batch in batches:
            cell, visits = [], []
            if batch.num_rows:
                for left, right in zip(*books.distances(unit_vectors(batch.column(2), size)), strict=True):
                    found = [i * k + j for i, j in nearest_cells(left, right, books.reach)]
                    cell.append(found[0])
                    visits.append([c for c in found if c > found[0]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                [*batch.schema.names, "cell", "visits"])

    return nodes.mapInArrow(work, extended(nodes, "cell long, visits array<long>"))


#: Parts a row plays in its cell: both sides, or one of them.
_BOTH, _STORED, _INNER, _OUTER = 0, 1, 2, 3


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows by (cell, m, p): the stored rows of block m and the looking rows of block p of a cell."""
    inner, outer = placed.groupBy("cell").agg(F.count("*").alias("inner")), placed.select(
        F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("outer"))
    blocks = stage(inner.join(outer, "cell", "left").select(
        "cell", F.ceil(F.col("inner") / BLOCK).alias("mb"),
        F.ceil((F.col("inner") + F.coalesce("outer", F.lit(0))) / BLOCK).alias("pb")), "blocks")
    row = ["cell", "node", "w", "v"]
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = placed.select(*row).join(blocks, "cell")
    seen = placed.select(F.explode("visits").alias("cell"), "node", "w", "v").join(blocks, "cell")
    zero = F.lit(0).cast("long")
    whole = (F.col("mb") == 1) & (F.col("pb") == 1)
    return (
        own.where(whole).select(*row, zero.alias("m"), zero.alias("p"), F.lit(_BOTH).alias("part"))
        .unionByName(own.where(~whole).select(*row, salt("mb").alias("m"), every("pb").alias("p"), F.lit(_STORED).alias("part")))
        .unionByName(own.where(~whole).select(*row, every("mb").alias("m"), salt("pb").alias("p"), F.lit(_INNER).alias("part")))
        .unionByName(seen.select(*row, every("mb").alias("m"), salt("pb").alias("p"), F.lit(_OUTER).alias("part")))
    )


def _met(table: pa.Table, size: int, least: float) -> pa.Table:
    """(node, links, low): weights of what a node links with here, and the least node it is tied to."""
    node, w, part = (table[c].to_numpy() for c in ("node", "w", "part"))
    unit = unit_vectors(table["v"].combine_chunks(), size)
    stored, looking = np.flatnonzero((part == _BOTH) | (part == _STORED)), np.flatnonzero(part != _STORED)
    names, at = np.unique(node, return_inverse=True)
    links, tied = np.zeros(len(names), np.int64), np.arange(len(names))
    for low in range(0, len(looking), TILE):
        rows = looking[low : low + TILE]
        i, j = np.nonzero(unit[rows] @ unit[stored].T >= least)
        i, j = rows[i], stored[j]
        once = (part[i] == _OUTER) | (node[i] < node[j])
        i, j = i[once], j[once]
        np.add.at(links, at[i], w[j])
        np.add.at(links, at[j], w[i])
        _tie(tied, at[i], at[j])
    linked = np.flatnonzero(links)
    return pa.table({"node": names[linked], "links": links[linked], "low": names[tied[linked]]})


def _tie(tied: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Carry the least position over all pairs until nothing changes."""
    while len(a):
        low = np.minimum(tied[a], tied[b])
        np.minimum.at(tied, a, low)
        np.minimum.at(tied, b, low)
        while (tied[tied] != tied).any():
            tied[:] = tied[tied]
        open_pairs = tied[a] != tied[b]
        a, b = tied[a[open_pairs]], tied[b[open_pairs]]


def _links(nodes: DataFrame, size: int, least: float, target: float, sample_rows: int, seed: int) -> DataFrame | None:
    """(node, links, low) of the vectors of one length, one row for every cell they link in."""
    own = nodes.where(F.size("v") == size)
    n = own.count()
    if n < 2:
        return None
    rows = own.where(draw(seed, F.xxhash64("v")) < sample_rows / n).select("k1", "k2", "v").toArrow()
    if rows.num_rows < 2:
        rows = own.limit(2).select("k1", "k2", "v").toArrow()
    rows = rows.sort_by([("k1", "ascending"), ("k2", "ascending")])
    books = fit(unit_vectors(rows["v"].combine_chunks(), size), codewords(n), least, target, seed)
    placed = stage(_placed(own.select("node", "w", "v"), books, size), "placed")
    return _dealt(placed).groupBy("cell", "m", "p").applyInArrow(
        lambda table: _met(table, size, least), "node long, links long, low long")


RESULT = ("n_links", "component_id", "kept")


def near_duplicates(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
    least: float = 0.95, target: float = 0.98, sample_rows: int = 16_384, seed: int = 7,
) -> DataFrame:
    """The id, ``keep`` columns, ``n_links``, ``component_id`` and ``kept`` of every row.

    Two vectors link if their cosine, in doubles, is ``least`` or more. ``n_links`` is
    the number of other rows linked with directly, ``component_id`` the least id
    reachable by links, and ``kept`` says whether that is the row's own. ``target`` is
    the share of links just at the threshold that the traversal is to reach; nearer
    ones are found more surely, and no pair below ``least`` ever counts. Only the
    codebooks and the reach come from a sample, of about ``sample_rows`` distinct
    vectors; all rows are indexed and all look for links.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing, and so do vectors of different lengths (each length has an index of
    its own). Equal vectors link; rows that share an id are separate rows. A null id
    is passed over in the minimum and its row not kept. An empty table gives an empty
    result; other columns are ignored, and names of the result replace those of
    ``keep``. Components stored as other numbers are read as doubles.
    """
    spark = prepare(rows.sparkSession)
    keep = tuple(c for c in keep if c not in (*RESULT, id_column))
    kind = rows.schema[vector].dataType.simpleString()
    v = F.col(f"`{vector}`") if kind == "array<float>" else F.col(f"`{vector}`").cast("array<double>")
    v = F.transform(v, lambda c: F.when(c == 0, F.abs(c)).otherwise(c))  # one zero
    named = [F.col(f"`{c}`") for c in keep]
    seen = rows.select(F.col(f"`{id_column}`").alias("_id"), *named, F.when(_usable(v), v).alias("_v"))
    keys = [F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(salt), "_v")).alias(k) for k, salt in (("k1", 1), ("k2", 2))]
    seen = seen.select("_id", *named, *keys, "_v")
    nodes = seen.where("_v is not null").groupBy("k1", "k2").agg(
        F.count("*").alias("w"), F.min("_id").alias("first"), F.any_value("_v").alias("v"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect())
    found = [f for s in sizes if (f := _links(nodes, s, least, target, sample_rows, seed)) is not None]
    met = spark.createDataFrame([], "node long, links long, low long")
    for one in found:
        met = met.unionByName(one)
    met = stage(met, "met")
    tied = components(met, "node", "low")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.select("node", "k1", "k2", "w", "first").join(tied, "node", "left").join(links, "node", "left").select(
        "k1", "k2", "w", "first", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = stage(classes, "classes")
    heads = classes.groupBy("component").agg(F.min("first").alias("head"))
    of_key = classes.join(heads, "component").select("k1", "k2", "head", (F.col("w") - 1 + F.col("links")).alias("n_links"))
    told = seen.drop("_v").join(of_key, ["k1", "k2"], "left")
    head = F.coalesce("head", "_id")
    return told.select(
        F.col("_id").alias(id_column), *named, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        head.alias("component_id"), F.coalesce(head == F.col("_id"), F.lit(False)).alias("kept"))


#: Brute force over all pairs; the same wherever the traversal missed no link.
ORACLE_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.y FROM reached r JOIN links l ON l.x = r.other),
heads AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN heads h ON h.vec_id = e.vec_id
"""
