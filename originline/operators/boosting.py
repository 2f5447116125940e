"""Gradient boosting of symmetric trees, for many classes and for ranked groups.

Spark's own boosted trees know two classes only. Here one tree a round has a vector of
leaf values, one per class, so all classes (each against the rest, tied together by
one softmax) share the splits of one prepared matrix. The same trees, with a single
value a leaf, rank the candidates of a sample by a listwise softmax: all candidates of
a sample lie in one row, so its gradients never leave a task.

The rows are prepared once as blocks of small bin numbers. A level of a tree is one
job: every block makes its margins from the trees so far, a histogram of gradients by
leaf, feature and bin, and the sums are added up over the cluster; only a histogram,
whose size depends on the model alone, reaches the driver. There is no state between
jobs, so a lost executor costs its blocks' work only. Gradients are whole numbers of
2^-20, whose sums do not depend on the order of addition: the fit is the same however
the rows are partitioned. Below the first level only the lighter half of every leaf is
counted; the other half is what the leaf had before less that, to the last unit.

Rows may be held out. They give no gradients, but every job reports how the model so
far does on them, so one fit yields the whole validation curve.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from originline.session import stage

UNIT = 1 << 20  # gradients are whole numbers of this part of one
STRETCH = 16_384  # rows whose cells and derivatives are added at once, while they are in the cache
SORTED = 65_536  # rows that a task sorts at a time to find borders
RANKS = 5_000  # values that it sends of each column and such rows
PARTIALS = 16  # partitions above which sums are added in a tree of tasks


@dataclasses.dataclass(frozen=True)
class Boost:
    """Settings of one fit."""

    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    l2: float = 3.0
    borders: int = 31
    share: float = 0.15  # of the features, drawn anew each round after the first
    patience: int = 5
    seed: int = 42


@dataclasses.dataclass(frozen=True)
class Tree:
    """Splits, one a level, and a vector of values per leaf.

    A row's leaf has bit k set if its bin of ``features[k]`` is above ``bins[k]``.
    """

    features: tuple[int, ...]
    bins: tuple[int, ...]
    values: tuple[tuple[float, ...], ...]


@dataclasses.dataclass(frozen=True)
class Block:
    """Rows of one batch: bins of all their candidates (one for a classifier), labels, held-out marks."""

    bins: np.ndarray  # (rows * width, features)
    labels: np.ndarray
    held: np.ndarray
    width: int


@dataclasses.dataclass(frozen=True)
class Round:
    """How the model of some rounds does on the rows held out."""

    rounds: int
    rows: int
    hits: int
    loss: float

    @property
    def accuracy(self) -> float:
        return self.hits / self.rows if self.rows else 0.0


# ---------------------------------------------------------------- inside a task


def binned(values: np.ndarray, borders: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of every value: 0 for a missing one, else one more than the borders at or below it."""
    out = np.empty(values.shape, np.uint8, order="F")
    for f, edges in enumerate(borders):
        column = values[:, f]
        at = np.searchsorted(np.asarray(edges, float), column, side="right") + 1
        out[:, f] = np.where(np.isnan(column), 0, at)
    return out


def leaves(bins: np.ndarray, features: Sequence[int], cuts: Sequence[int]) -> np.ndarray:
    kind = np.uint8 if len(features) <= 8 else np.int64
    out = np.zeros(len(bins), kind)
    for k, (f, b) in enumerate(zip(features, cuts, strict=True)):
        out |= (bins[:, f] > b).astype(kind) << kind(k)
    return out


def margins(bins: np.ndarray, trees: Sequence[Tree], start: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Margins by (value, row), of some rows only if they are told."""
    n = len(bins) if isinstance(rows, slice) else len(rows)
    out = np.repeat(np.asarray(start, float)[:, None], n, axis=1)
    step = np.empty(n)
    for tree in trees:
        leaf = leaves(bins, tree.features, tree.bins)[rows].astype(np.intp)
        for total, values in zip(out, np.asarray(tree.values).T.copy(), strict=True):
            total += values.take(leaf, out=step, mode="clip")  # no leaf is outside; other modes copy
    return out


def softmax(x: np.ndarray, axis: int = 1) -> np.ndarray:
    raised = np.exp(x - x.max(axis=axis, keepdims=True))
    return raised / raised.sum(axis=axis, keepdims=True)


def columns(bins: np.ndarray, trees: Sequence[Tree], start: np.ndarray, width: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Probabilities by (class or candidate, row); ``rows`` count every candidate of a sample."""
    m = margins(bins, trees, start, rows)
    return softmax(m if width == 1 else np.ascontiguousarray(m.reshape(-1, width).T), axis=0)


def shares(bins: np.ndarray, trees: Sequence[Tree], start: np.ndarray, width: int) -> np.ndarray:
    """Probabilities by row: of its classes, or of its candidates."""
    return columns(bins, trees, start, width).T


def derivatives(p: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """First and second derivatives by (order, class or candidate, row), in whole units."""
    both = np.stack([-p, p * (1.0 - p)])
    both[0, labels, np.arange(len(labels))] += 1.0
    both *= UNIT
    return np.rint(both, out=both)


def gradients(p: np.ndarray, labels: np.ndarray, held: np.ndarray) -> np.ndarray:
    """First and second derivatives of the log-likelihood by every margin, in whole units; 0 for rows held out."""
    both = derivatives(p.T, labels).transpose(0, 2, 1).astype(np.int64)
    both[:, held] = 0
    return both


def histogram(
    block: Block, trees: Sequence[Tree], start: np.ndarray, splits: tuple[Sequence[int], Sequence[int]], features: Sequence[int], n_bins: int,
    counted: Sequence[int] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums by (feature, leaf, bin, value), and (rows, hits, loss) of the rows held out.

    With ``counted``, one leaf for each leaf before the last split, only the rows in
    these are summed, in the place of the leaf they were split from; nothing is told.
    """
    leaf, n_leaves = leaves(block.bins, *splits), 1 << len(splits[0])
    live = np.repeat(~block.held, block.width)
    if counted is None:
        rows, inside, labels = slice(None), np.flatnonzero(live), block.labels
    else:
        n_leaves >>= 1
        live &= np.isin(np.arange(2 * n_leaves), counted)[leaf]
        # A sample is looked at whole if any of its candidates counts.
        own = live.reshape(-1, block.width).any(axis=1)
        rows, labels = np.flatnonzero(np.repeat(own, block.width)), block.labels[own]
        inside = np.flatnonzero(live[rows])
    p = columns(block.bins, trees, start, block.width, rows)
    k = len(p) if block.width == 1 else 1
    g = derivatives(p, labels)
    g = (g if block.width == 1 else g.transpose(0, 2, 1)).reshape(2 * k, -1)
    at = inside if counted is None else rows[inside]
    if len(inside) < g.shape[1]:
        g = g.take(inside, axis=1)
    base = (leaf[at].astype(np.intp) & (n_leaves - 1)) * n_bins
    out = np.zeros((len(features), 2 * k, n_leaves * n_bins))
    # Sums of whole numbers far below 2^53: doubles add them without a rest.
    for low in range(0, len(at), STRETCH):
        span = slice(low, low + STRETCH)
        for i, f in enumerate(features):
            cell = base[span] + block.bins[:, f].take(at[span])
            for total, part in zip(out[i], g[:, span], strict=True):
                total += np.bincount(cell, part, n_leaves * n_bins)
    told = np.zeros(3, np.int64)
    if counted is None and block.held.any():
        q, y = p[:, block.held], block.labels[block.held]
        loss = -np.log(np.maximum(q[y, np.arange(len(y))], 1e-12))
        told[:] = len(y), (q.argmax(axis=0) == y).sum(), np.rint(loss * UNIT).sum()
    whole = out.reshape(len(features), 2 * k, n_leaves, n_bins).transpose(0, 2, 3, 1).astype(np.int64)
    return np.ascontiguousarray(whole), told


# ----------------------------------------------------------------- on the driver


def best_split(sums: np.ndarray, l2: float) -> tuple[int, int]:
    """(feature position, bin) of the cut that gains most over all leaves and values; the first on a tie."""
    k = sums.shape[3] // 2
    below = np.cumsum(sums, axis=2)[:, :, :-1].astype(float)
    above = sums.sum(axis=2, keepdims=True) - below
    gain = sum((s[..., :k] ** 2 / (s[..., k:] + l2 * UNIT)).sum(axis=(1, 3)) for s in (below, above))
    at = int(np.argmax(np.round(gain / UNIT, 9)))
    return divmod(at, gain.shape[1])


def leaf_values(sums: np.ndarray, cut: int, l2: float, rate: float) -> tuple[tuple[float, ...], ...]:
    """Newton steps of both sides of a cut, from the histogram (leaf, bin, value) of its feature."""
    k = sums.shape[2] // 2
    below = sums[:, : cut + 1].sum(axis=1)
    both = np.concatenate([below, sums.sum(axis=1) - below])
    return tuple(map(tuple, (rate * both[:, :k] / (both[:, k:] + l2 * UNIT)).tolist()))


def lighter(sums: np.ndarray, cut: int) -> list[int]:
    """Of the two leaves that a cut makes of every leaf the one of less curvature, from the histogram of the cut's feature."""
    weight = sums[..., sums.shape[2] // 2 :].sum(axis=2)
    n = len(weight)
    above = 2 * weight[:, cut + 1 :].sum(axis=1) < weight.sum(axis=1)
    return [leaf + n * int(up) for leaf, up in enumerate(above)]


def completed(before: np.ndarray, part: np.ndarray, counted: Sequence[int]) -> np.ndarray:
    """The histogram of all leaves from that of the leaves ``counted`` and the one before the split."""
    n = before.shape[1]
    out = np.empty((len(before), 2 * n, *before.shape[2:]), before.dtype)
    for leaf, own in enumerate(counted):
        out[:, own], out[:, own ^ n] = part[:, leaf], before[:, leaf] - part[:, leaf]
    return out


class Matrix:
    """The prepared blocks of one set of rows, shared by all fits on them.

    ``features`` is an array of numbers, one such array per candidate, or what :func:`packed` makes.
    """

    def __init__(self, rows: DataFrame, features: Column, labels: dict[str, Column], held: Column, borders: list[list[float]], width: int = 1) -> None:
        self.width, self.borders = width, borders
        names = list(labels)
        columns = rows.select(features.alias("x"), held.alias("held"), *[c.cast("int").alias(n) for n, c in labels.items()])
        n_features, n_labels = len(borders), len(labels)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                told = batch.column(0)
                x = _unpacked(told, n_features) if pa.types.is_binary(told.type) else binned(_dense(told, n_features), borders)
                marks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                labels = [batch.column(2 + k).to_numpy().astype(np.int32).tobytes() for k in range(n_labels)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes("F")], pa.binary()), pa.array([marks.tobytes()], pa.binary()),
                     *[pa.array([b], pa.binary()) for b in labels]],
                    ["bins", "held", *names])

        ddl = "bins binary, held binary, " + ", ".join(f"`{n}` binary" for n in names)
        self.frame = stage(columns.mapInArrow(pack, ddl), "blocks")

        def block(row) -> dict[str, Block]:
            bins = np.frombuffer(row["bins"], np.uint8).reshape(n_features, -1).T  # a feature's bins side by side
            marks = np.frombuffer(row["held"], bool)
            return {n: Block(bins, np.frombuffer(row[n], np.int32), marks, width) for n in names}

        self.blocks = self.frame.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, name: str, *how, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The blocks' histograms added up; held-out rows give gradients like any other with ``every``."""

        def one(b: dict[str, Block]) -> tuple[np.ndarray, np.ndarray]:
            block = b[name]
            return histogram(dataclasses.replace(block, held=block.held & False) if every else block, *how)

        made = self.blocks.map(one)
        add = lambda x, y: (x[0] + y[0], x[1] + y[1])
        return made.treeReduce(add) if made.getNumPartitions() > PARTIALS else made.reduce(add)

    def counts(self, name: str, classes: int, every: bool = False) -> np.ndarray:
        """How many rows have each label; of those not held out, or of ``every`` one."""
        made = self.blocks.map(lambda b: np.bincount(b[name].labels[~b[name].held | every], minlength=classes))
        return made.fold(np.zeros(classes, np.int64), lambda x, y: x + y)

    def close(self) -> None:
        self.blocks.unpersist()


def ranked_values(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each is there; of more than ``most``, neighbours in rank go with the greatest.

    The least value stays by itself, and no value moves by more than ``len(values) / most`` ranks.
    """
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) > most:
        place = np.cumsum(counts) * (most - 1) // len(values)
        last = np.flatnonzero(np.concatenate([[True], place[2:] != place[1:-1], [True]]))
        total = np.cumsum(counts)[last]
        distinct, counts = distinct[last], np.diff(total, prepend=0)
    return distinct, counts


def find_borders(rows: DataFrame, columns: Sequence[str], most: int) -> list[list[float]]:
    """Up to ``most`` distinct quantiles of every column, the least value left out: one pass over all rows.

    A task sorts a stretch of rows and sends ranked values; those of one column meet in
    one group, which is smaller than the column by the length of a stretch over ``RANKS``.
    Of up to ``RANKS`` distinct values a stretch the quantiles are exact, else their rank
    is right to the number of rows over ``RANKS``.
    """
    cells = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def told(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        made = []
        for i in range(len(columns)):
            x = np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches])
            made.append(ranked_values(x[~np.isnan(x)], RANKS))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(columns)), pa.int32()), *(pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1))],
            ["at", "found", "counts"])

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= SORTED:
                yield told(waiting)
                waiting = []
        if sum(b.num_rows for b in waiting):
            yield told(waiting)

    def quantiles(group: pa.Table) -> pa.Table:
        found, counts = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("found", float), ("counts", np.int64)))
        order = np.argsort(found, kind="stable")
        found, total = found[order], np.cumsum(counts[order])
        if not len(found):
            return pa.table({"at": group["at"][:1], "borders": pa.array([[]], pa.list_(pa.float64()))})
        wanted = np.arange(1, most + 1) / (most + 1) * total[-1]
        picked = np.unique(found[np.searchsorted(total, wanted)])
        return pa.table({"at": group["at"][:1], "borders": pa.array([picked[picked > found[0]]], pa.list_(pa.float64()))})

    sent = cells.mapInArrow(ranks, "at int, found binary, counts binary")
    # A few borders a column reach the driver.
    borders = {r["at"]: list(r["borders"]) for r in sent.groupBy("at").applyInArrow(quantiles, "at int, borders array<double>").collect()}
    return [borders.get(i, []) for i in range(len(columns))]


def boost(
    matrix: Matrix, name: str, classes: int, s: Boost, curve: bool = False, without: Sequence[int] = (),
) -> tuple[list[Tree], list[float], list[Round]]:
    """Fit on the rows of ``matrix`` that are not held out: trees, start values, and the validation curve.

    With ``curve`` the fit goes on until ``s.patience`` rounds have not beaten the best
    accuracy on the rows held out, ``s.rounds`` at most. Without it, all rounds run.

    The first tree chooses among all features. A draw may miss the few that tell the
    label, and a first tree of features that drift with time does not hold on later
    rows; the search would end before the others had their turn. A classifier starts at
    the logarithms of its labels' shares, so that where features tell little it answers
    the commonest label; its curve begins with no tree at all, which the search may choose.
    No tree reads the features of ``without``.
    """
    ranked = matrix.width > 1
    k, n_features, n_bins = (1 if ranked else classes), len(matrix.borders), s.borders + 2
    start = np.zeros(k)
    trees: list[Tree] = []
    told: list[Round] = []
    rng = np.random.default_rng(s.seed)
    usable = [f for f, edges in enumerate(matrix.borders) if edges and f not in without]
    if not usable:
        return [], start.tolist(), told
    if not ranked:
        n = matrix.counts(name, classes) + 1
        start = np.log(n / n.sum())
    take = min(len(usable), max(1, round(s.share * n_features)))
    for _ in range(s.rounds):
        drawn = sorted(rng.choice(usable, size=take, replace=False).tolist()) if trees else usable
        features: list[int] = []
        cuts: list[int] = []
        for level in range(s.depth):
            counted = lighter(sums[at], cut) if level else None
            part, held = matrix.sums(name, tuple(trees), start, (tuple(features), tuple(cuts)), drawn, n_bins, counted)
            sums = completed(sums, part, counted) if level else part
            if level == 0 and curve and (trees or not ranked):
                told.append(Round(len(trees), *held[:2].tolist(), float(held[2]) / UNIT))
                if stopped(told, s.patience):
                    return trees, start.tolist(), told
            at, cut = best_split(sums, s.l2)
            features.append(drawn[at])
            cuts.append(cut)
        values = leaf_values(sums[at], cut, s.l2, s.rate)
        trees.append(Tree(tuple(features), tuple(cuts), values))
    if curve:
        _, held = matrix.sums(name, tuple(trees), start, ((), ()), drawn[:1], n_bins)
        told.append(Round(len(trees), *held[:2].tolist(), float(held[2]) / UNIT))
    return trees, start.tolist(), told


def best_round(told: Sequence[Round]) -> int:
    """The first of the rounds with most hits, none if no tree beats the label shares; one if nothing was held out."""
    if told and not told[0].rows:
        return 1
    return max(told, key=lambda r: (r.hits, -r.rounds)).rounds if told else 1


def stopped(told: Sequence[Round], patience: int) -> bool:
    return bool(told) and told[-1].rounds - best_round(told) >= patience


# ------------------------------------------------------------------ the ML pair


def packed(features: Column, borders: list[list[float]]) -> Column:
    """The bins of an array of numbers, a byte each: what rows carry through a shuffle before they are blocks."""

    @F.arrow_udf("binary")
    def work(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.binary())
        rows = np.ascontiguousarray(binned(_dense(column, len(borders)), borders))
        return pa.array([r.tobytes() for r in rows], pa.binary())

    return work(features)


def _unpacked(column: pa.Array, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n_features)


def _dense(column: pa.Array, n_features: int) -> np.ndarray:
    """A batch's (nested) lists as one row of doubles per row or candidate; null is NaN."""
    flat = column.flatten()
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_features)


class _BoostParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "array of numbers, or of one such array per candidate", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class, or place of the right candidate", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "array of probabilities", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "classes, or candidates of a row", TypeConverters.toInt)
    ranked = Param(Params._dummy(), "ranked", "whether rows are lists of candidates", TypeConverters.toBoolean)

    def take(self, given: dict) -> None:
        """Parameters that were given, over the defaults."""
        self._setDefault(featuresCol="features", labelCol="label", probabilityCol="probability", classes=2, ranked=False)
        self._set(**given)


class BoostedTrees(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator form of :func:`boost`: rows with an array of features and a label."""

    settings = Param(Params._dummy(), "settings", "settings of the fit, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, probabilityCol=None, classes=None, ranked=None, settings=None):
        super().__init__()
        self._setDefault(settings="{}")
        self.take(self._input_kwargs)

    def _fit(self, rows: DataFrame) -> BoostedModel:
        s = Boost(**json.loads(self.getOrDefault("settings")))
        width = self.getOrDefault("classes") if self.getOrDefault("ranked") else 1
        features = F.col(self.getOrDefault("featuresCol"))
        sample = features[0] if width > 1 else features
        n = rows.select(F.size(sample)).first()
        if n is None:
            raise ValueError("there is no row to fit on")
        one = rows.select(F.explode(features).alias("x")) if width > 1 else rows.select(features.alias("x"))
        borders = find_borders(one.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(n[0])]), [f"x{i}" for i in range(n[0])], s.borders)
        matrix = Matrix(rows, features, {"label": F.col(self.getOrDefault("labelCol"))}, F.lit(False), borders, width)
        try:
            trees, start, _ = boost(matrix, "label", self.getOrDefault("classes"), s)
        finally:
            matrix.close()
        model = boosted_model(trees, start, borders, self.getOrDefault("classes"), width > 1)
        return self._copyValues(model)


class BoostedModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; all of them is a parameter, so the default writer saves and loads it."""

    fitted = Param(Params._dummy(), "fitted", "borders, start values and trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, probabilityCol=None, classes=None, ranked=None, fitted=None):
        super().__init__()
        self.take(self._input_kwargs)

    def parts(self) -> tuple[list[Tree], np.ndarray, list[list[float]]]:
        found = json.loads(self.getOrDefault("fitted"))
        trees = [Tree(tuple(f), tuple(b), tuple(map(tuple, v))) for f, b, v in found["trees"]]
        return trees, np.asarray(found["start"], float), found["borders"]

    @property
    def rounds(self) -> int:
        return len(json.loads(self.getOrDefault("fitted"))["trees"])

    def gains(self) -> list[tuple[int, float]]:
        """How far the trees' cuts on each feature move the margins: (feature, share)."""
        trees, _, borders = self.parts()
        moved = np.zeros(len(borders))
        for tree in trees:
            values = np.asarray(tree.values)
            for level, f in enumerate(tree.features):
                with_bit = (np.arange(len(values)) >> level & 1).astype(bool)
                moved[f] += np.abs(values[with_bit] - values[~with_bit]).sum()
        return list(enumerate((moved / max(moved.sum(), 1e-300)).tolist()))

    def scorer(self) -> Callable[[pa.Array], pa.Array]:
        """What makes a batch of feature arrays to arrays of probabilities."""
        trees, start, borders = self.parts()
        width = self.getOrDefault("classes") if self.getOrDefault("ranked") else 1

        def score(column: pa.Array) -> pa.Array:
            if len(column) == 0:
                return pa.array([], pa.list_(pa.float64()))
            p = shares(binned(_dense(column, len(borders)), borders), trees, start, width)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        return score

    def probabilities(self, features: Column) -> Column:
        score = self.scorer()

        @F.arrow_udf("array<double>")
        def work(column: pa.Array) -> pa.Array:
            return score(column)

        return work(features)

    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.getOrDefault("probabilityCol"), self.probabilities(F.col(self.getOrDefault("featuresCol"))))


def boosted_model(trees: Sequence[Tree], start: Sequence[float], borders: list[list[float]], classes: int, ranked: bool) -> BoostedModel:
    fitted = {"trees": [dataclasses.astuple(t) for t in trees], "start": list(start), "borders": borders}
    return BoostedModel(classes=classes, ranked=ranked, fitted=json.dumps(fitted))
