"""A quality classifier by co-training two views of a document.

One classifier sees only the text: what it looks like, and what its words say. The
other sees only the page's metadata (source, language, length). Each is fitted on
labelled rows; in every round each labels the unlabelled rows it is sure of for the
other one. In the end both are calibrated on labelled rows held out of the fit, and
their evidence is added up: the logits' sum less the base rate that both contain.

The words' evidence is a sparse logistic regression on hashed words, word
beginnings and pairs of words of the whole text. It is fitted again in every round,
also on the rows that the metadata are sure of, and joins the text view as one
feature, made for every row by models that did not see its text. A second
regression of this kind, on the ``toxic`` label, is a verdict of its own.
"""

from __future__ import annotations

import dataclasses
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originline.llm.common import SPACES, draw, extended, mix, prepare, slices, text_bytes, word_hashes
from originline.session import stage

SOURCES, LANGS = 32, 8
#: Byte classes whose shares describe a text's look.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"?-()", b"!", b"|",
    b"#$%&*^~+=<>@\\/_{}[]", b"\n", b" \t\r\x0b\x0c",
)
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
#: Bits of a hashed word feature; bytes of a word's beginning.
WORD_BITS, STEM = 20, 6
#: Features of one regression at most, and the least likelihood ratio of one.
FEATURES, LEAST_GAIN = 4096, 12.0
#: Parts of the sampled texts that are left out of a fit in turn.
FOLDS = 4
#: Letters, digits and bytes beyond ASCII stay; all else separates words.
_FOLD = np.array([b if b > 127 or chr(b).isalnum() else SPACES[0] for b in range(256)], np.uint8)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word beginnings and word pairs of whole texts, each once a text, and their n + 1 bounds."""
    data, offsets = text_bytes(texts)
    data, found, counts = _FOLD[data], [], []
    for low, high in slices(data, offsets):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        words, bounds = word_hashes(part, own)
        of = np.repeat(np.arange(high - low, dtype=np.int64), np.diff(bounds))
        stems, _ = word_hashes(_stemmed(part, own), own)
        with np.errstate(over="ignore"):
            pairs = mix(words[:-1] * np.uint64(0x100000001B3) + words[1:])
            stems = mix(stems + np.uint64(0x51ED270B))
        same = of[1:] == of[:-1]
        values = np.concatenate([words, stems, pairs[same]]) >> np.uint64(64 - WORD_BITS)
        key = np.unique((np.concatenate([of, of, of[1:][same]]) << WORD_BITS) | values.astype(np.int64))
        found.append((key & ((1 << WORD_BITS) - 1)).astype(np.int32))
        counts.append(np.bincount(key >> WORD_BITS, minlength=high - low))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))])
    return np.concatenate(found) if found else np.zeros(0, np.int32), bounds.astype(np.int64)


def _stemmed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with all of a word blanked but its first ``STEM`` bytes."""
    first = data != SPACES[0]
    first[1:] &= data[:-1] == SPACES[0]
    inner = offsets[offsets < len(data)]
    first[inner] = data[inner] != SPACES[0]
    at = np.arange(len(data), dtype=np.int64)
    return np.where(at - np.maximum.accumulate(np.where(first, at, 0)) < STEM, data, SPACES[0])


def text_view(texts: pa.Array) -> np.ndarray:
    """The text view: shares of byte classes, word lengths, and repetition; the length is the metadata's."""
    data, offsets = text_bytes(texts)
    n, kinds = len(offsets) - 1, len(_CLASSES) + 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * kinds + _CLASS[data], minlength=n * kinds).reshape(n, kinds) / np.maximum(size, 1)[:, None]
    words, bounds = word_hashes(data, offsets)
    count = np.diff(bounds)
    of = np.repeat(np.arange(n), count)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    echo = np.bincount(of[same], minlength=n) / np.maximum(count, 1)
    order = np.lexsort((words, of))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    types = np.bincount(of[order][fresh], minlength=n)
    rare = types / np.maximum(np.sqrt(count), 1)
    length = shares[:, :3].sum(axis=1) * size / np.maximum(count, 1)
    base = np.column_stack([shares, echo, types / np.maximum(count, 1)])
    return np.column_stack([base, np.sqrt(base), np.minimum(length, 30), np.minimum(rare, 30)])


@functools.lru_cache(maxsize=4096)
def _bucket(value: str | None, n: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (n - 1)


def page_view(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """The metadata view: hashed source and language, and the length; nulls are values of their own."""
    n = len(source)
    out = np.zeros((n, SOURCES + LANGS + 3))
    rows = np.arange(n)
    out[rows, [_bucket(s, SOURCES) for s in source]] = 1
    out[rows, [SOURCES + _bucket(s, LANGS) for s in lang]] = 1
    known = ~np.isnan(n_chars)
    length = np.log1p(np.maximum(np.where(known, n_chars, 0.0), 0.0))
    out[:, -3], out[:, -2], out[:, -1] = ~known, length, length**2 / 10
    return out


@dataclasses.dataclass
class Logistic:
    """Logistic regression on standardised features, with a Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weight[1:] + self.weight[0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.platt[0] * self.margin(x) + self.platt[1], -12, 12)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray, ridge: float = 1.0) -> Logistic:
    """Fit on (x, y), calibrate on (xc, yc); a constant calibration set leaves the fit as it is."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    model = Logistic(mean, scale, np.zeros(x.shape[1] + 1))
    model.weight = _newton(np.clip((x - mean) / scale, -8, 8), y, ridge)
    if 0 < yc.sum() < len(yc):
        b, a = _newton(model.margin(xc)[:, None], yc, 1e-3)
        if a > 0:
            model.platt = (float(a), float(b))
        else:
            model.platt = (0.0, float(np.log(yc.mean() / (1 - yc.mean()))))
    return model


@dataclasses.dataclass
class Words:
    """Logistic regression on the presence of hashed words, with a Platt calibration."""

    ids: np.ndarray  # sorted features
    weight: np.ndarray
    bias: float
    platt: tuple[float, float] = (1.0, 0.0)

    def margin(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        owner, column = _columns(self.ids, ids, bounds)
        return self.bias + np.bincount(owner, self.weight[column], minlength=len(bounds) - 1)

    def logit(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.clip(self.platt[0] * self.margin(ids, bounds) + self.platt[1], -12, 12)


def _columns(known: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position in ``known`` of every feature that is there."""
    place = np.full(1 << WORD_BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    column = place[ids]
    hit = np.flatnonzero(column >= 0)
    return np.searchsorted(bounds, hit, side="right") - 1, column[hit]


class Design:
    """Which features rows hold, as positions in ``known``; products with it go through slices of ``STEP`` entries."""

    STEP = 1 << 20

    def __init__(self, known: np.ndarray, ids: np.ndarray, bounds: np.ndarray):
        place = np.full(1 << WORD_BITS, -1, np.int32)
        place[known] = np.arange(len(known))
        parts, ends = [], [np.zeros(1, np.int64)]
        for low, high in slices(ids, bounds, self.STEP):
            at = place[ids[bounds[low] : bounds[high]]]
            live = at >= 0
            parts.append(at[live].astype(np.min_scalar_type(max(len(known), 1))))
            ends.append(ends[-1][-1] + np.concatenate([[0], np.cumsum(live)])[bounds[low + 1 : high + 1] - bounds[low]])
        self.column = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.bounds, self.width = np.concatenate(ends), len(known)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """By row the sum of its features' weights."""
        out = np.zeros(len(self.bounds) - 1)
        for low, high in slices(self.column, self.bounds, self.STEP):
            begin, end = self.bounds[low:high], self.bounds[low + 1 : high + 1]
            full = np.flatnonzero(end > begin)
            if len(full):
                out[low + full] = np.add.reduceat(weight[self.column[begin[0] : end[-1]]], begin[full] - begin[0])
        return out

    def totals(self, value: np.ndarray) -> np.ndarray:
        """By feature the sum of its rows' values."""
        out = np.zeros(self.width)
        for low, high in slices(self.column, self.bounds, self.STEP):
            spread = np.repeat(value[low:high], np.diff(self.bounds[low : high + 1]))
            out += np.bincount(self.column[self.bounds[low] : self.bounds[high]], spread, minlength=self.width)
        return out


def _fit_words(known: np.ndarray, ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, near: Words | None = None, ridge: float = 0.3) -> Words:
    """Fit on the features in ``known`` by Newton steps, each solved by conjugate gradients, so that no square matrix is made.

    ``near`` is the fit of nearly the same rows, to start from; two short steps lead from there.
    """
    design, k = Design(known, ids, bounds), len(known)
    keep = np.append(np.full(k, ridge), 1e-6)
    forward = lambda v: v[k] + design.sums(v)
    back = lambda r: np.append(design.totals(r), r.sum())
    w = np.zeros(k + 1)
    w[k] = np.log(y.mean() / (1 - y.mean()))
    if near is not None:
        _, here, there = np.intersect1d(known, near.ids, assume_unique=True, return_indices=True)
        w[here], w[k] = near.weight[there], near.bias
    steps, inner = (10, 30) if near is None else (2, 15)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        r = -(back(p - y) + keep * w)
        scale = 1 / (back(curve) + keep)
        step, z = np.zeros(k + 1), scale * r
        d, rz, first = z, r @ z, r @ z
        for _ in range(inner):
            if rz <= 1e-6 * first or rz < 1e-12:
                break
            image = back(curve * forward(d)) + keep * d
            a = rz / (d @ image)
            step, r = step + a * d, r - a * image
            z = scale * r
            rz, old = r @ z, rz
            d = z + rz / old * d
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 3e-2:
            break
    return Words(known, w[:k], float(w[k]))


def _take(ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features and bounds of some rows."""
    if len(rows) == len(bounds) - 1 and (rows[1:] > rows[:-1]).all():
        return ids, bounds
    out = np.concatenate([[0], np.cumsum(np.diff(bounds)[rows])])
    taken = np.empty(out[-1], ids.dtype)
    for k, row in enumerate(rows.tolist()):
        taken[out[k] : out[k + 1]] = ids[bounds[row] : bounds[row + 1]]
    return taken, out


@dataclasses.dataclass
class WordRows:
    """Sampled rows as lists of telling features: those of each fit, and the fold of every row's text."""

    ids: np.ndarray
    bounds: np.ndarray
    fold: np.ndarray
    known: dict[int, np.ndarray]  # by the fold left out; -1 for none

    near: dict[int, Words] = dataclasses.field(default_factory=dict)  # the last fits, to start the next ones from

    def fit(self, y: np.ndarray) -> Words:
        """A fit on the rows with ``y`` of 0 or 1."""
        at = np.flatnonzero(y >= 0)
        self.near[-1] = _fit_words(self.known[-1], *_take(self.ids, self.bounds, at), y[at], self.near.get(-1))
        return self.near[-1]

    def margins(self, y: np.ndarray) -> np.ndarray:
        """For every row the margin of a fit on the rows with ``y`` of 0 or 1, but those of its fold."""
        at = np.flatnonzero(y >= 0)
        margin = np.zeros(len(y))
        for k in range(FOLDS):
            out, rest = np.flatnonzero(self.fold == k), at[self.fold[at] != k]
            if len(out) == 0:
                continue
            if 0 < y[rest].sum() < len(rest):
                self.near[k] = _fit_words(
                    self.known[k], *_take(self.ids, self.bounds, rest), y[rest], self.near.get(k, self.near.get(-1)))
                model = self.near[k]
            else:
                model = self.fit(y)
            margin[out] = model.margin(*_take(self.ids, self.bounds, out))
        return margin


def cross_fit(rows: WordRows, y: np.ndarray) -> Words | None:
    """A fit on the rows with a label, calibrated by margins of fits that did not see a row's text.

    None if ``y`` shows a single class.
    """
    at = y >= 0
    if not 0 < y[at].sum() < at.sum():
        return None
    model, margin = rows.fit(y), rows.margins(y)
    b, a = _newton(margin[at][:, None], y[at], 1e-3)
    mean = y[at].mean()
    model.platt = (float(a), float(b)) if a > 0 else (0.0, float(np.log(mean / (1 - mean))))
    return model


@dataclasses.dataclass
class CoTrained:
    """Both views and the base rate they share."""

    text: Logistic
    page: Logistic
    prior: float
    rounds: int
    words: Words | None = None

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.text.logit(a) + self.page.logit(b) - self.prior)))


def co_train(
    a: np.ndarray, b: np.ndarray, y: np.ndarray, pool_a: np.ndarray, pool_b: np.ndarray,
    rounds: int = 3, sure: float = 0.98, held: int = 4, words: WordRows | None = None,
) -> CoTrained | None:
    """Exchange confident labels between the views for some rounds.

    ``y`` holds 0 and 1; every ``held``-th labelled row calibrates and is not fitted by
    a view. A view gives the other one equally many labels of either class, by the base
    rate, its surest first. ``words`` holds the features of the labelled rows and then
    of the pool: its regression is fitted again in every round, on the labelled rows
    and on what the metadata view is sure of, and its margins are the text view's first
    feature. None if the labelled rows show a single class.
    """
    if not 0 < y.sum() < len(y):
        return None
    n = len(y)
    out = np.arange(n) % held == 0
    if not (0 < y[out].sum() < out.sum() and 0 < y[~out].sum() < (~out).sum()):
        out = np.zeros(n, bool)
    every_a, every_b = np.vstack([a, pool_a]), np.vstack([b, pool_b])
    fitted = np.concatenate([~out, np.ones(len(pool_a), bool)])
    calibrating = np.flatnonzero(out) if out.any() else np.arange(n)
    rate = y[~out].mean()
    prior = float(np.log(rate / (1 - rate)))
    unknown = np.concatenate([y, np.full(len(pool_a), -1.0)])
    given = {"text": unknown, "page": unknown}

    def view(x: np.ndarray, labels: np.ndarray) -> Logistic:
        at = np.flatnonzero(fitted & (labels >= 0))
        return fit_view(x[at], labels[at], x[calibrating], y[calibrating])

    def fit() -> tuple[Logistic, Logistic, np.ndarray]:
        x = every_a if words is None else _told(every_a, words.margins(given["text"]))
        return view(x, given["text"]), view(every_b, given["page"]), x

    if words is not None:
        words.fit(unknown)  # the others start from it
    text, page, x = fit()
    for _ in range(rounds if len(pool_a) else 0):
        for judge, seen, other in ((text, x, "page"), (page, every_b, "text")):
            p = 1 / (1 + np.exp(-judge.logit(seen[n:])))
            good, bad = np.flatnonzero(p >= sure), np.flatnonzero(p <= 1 - sure)
            n_bad = min(len(bad), int(len(good) * (1 - rate) / rate))
            n_good = min(len(good), int(n_bad * rate / (1 - rate)))
            given[other] = unknown.copy()
            given[other][n + good[np.argsort(-p[good], kind="stable")[:n_good]]] = 1.0
            given[other][n + bad[np.argsort(p[bad], kind="stable")[:n_bad]]] = 0.0
        text, page, x = fit()
    return CoTrained(text, page, prior, rounds, words and words.fit(given["text"]))


_VIEW = "struct<text:string,source:string,lang:string,n_chars:double>"


def _viewed(docs: DataFrame, keep: list[str]) -> DataFrame:
    columns = set(docs.columns)
    parts = [(F.col(c) if c in columns else F.lit(None)).cast(t).alias(c)
             for c, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "double"))]
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.struct(*parts).alias("_view"))


@dataclasses.dataclass
class Judge:
    """All that was learned; a part is None where its label shows a single class."""

    quality: CoTrained | None = None
    words: Words | None = None  # the words' evidence on quality, a feature of the text view
    toxic: Words | None = None


def _views(view: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text view without the words' evidence, metadata view, word features and their bounds."""
    text, source, lang, n_chars = view.flatten()
    lengths = n_chars.to_numpy(zero_copy_only=False).astype(float)
    return text_view(text), page_view(source.to_pylist(), lang.to_pylist(), lengths), *word_features(text)


def _told(a: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """The text view with the words' evidence as its first feature."""
    return np.column_stack([np.clip(evidence, -12, 12), a])


def _lists(values: np.ndarray, bounds: np.ndarray | None = None) -> pa.Array:
    if bounds is None:
        bounds, values = np.arange(len(values) + 1) * values.shape[1], values.ravel()
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _sampled(docs: DataFrame, labels: DataFrame, labelled_rows: int, pool_rows: int, seed: int) -> DataFrame:
    """Features of the sampled rows, staged: labels (-1 unknown), the fold of the text, an order, both views, word features."""
    n_labels, n_docs = labels.count(), docs.count()
    unit = draw(seed, F.col("doc_id"))
    known = labels.where(unit < labelled_rows / max(n_labels, 1)).groupBy("doc_id").agg(
        F.coalesce(F.min("quality"), F.lit(-1)).cast("int").alias("_y"), F.coalesce(F.max("toxic"), F.lit(-1)).cast("int").alias("_t"))
    share = pool_rows / max(n_docs, 1)
    free = docs.where("doc_id is not null").select("doc_id").where(unit < share).distinct().join(
        labels.where(unit < share).select("doc_id"), "doc_id", "left_anti")
    marks = known.select("doc_id", "_y", "_t", F.lit(False).alias("_pool")).unionByName(
        free.select("doc_id", F.lit(-1).alias("_y"), F.lit(-1).alias("_t"), F.lit(True).alias("_pool")))
    # About labelled_rows + pool_rows ids: bounded by the parameters.
    rows = _viewed(docs.join(F.broadcast(stage(marks, "marks")), "doc_id"), ["doc_id", "_y", "_t", "_pool"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids, bounds = _views(batch.column(4))
            sums = np.concatenate([[0], np.cumsum(ids, dtype=np.int64)])
            text = mix((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.uint64))
            with np.errstate(over="ignore"):
                order = mix(batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x100000001B3) + text)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (1, 2, 3)), pa.array((text % np.uint64(FOLDS)).astype(np.int32)), pa.array(order.view(np.int64)),
                 _lists(a), _lists(b), _lists(ids, bounds)],
                ["y", "t", "pool", "fold", "place", "a", "b", "ids"])

    ddl = "y int, t int, pool boolean, fold int, place long, a array<double>, b array<double>, ids array<int>"
    return stage(rows.mapInArrow(describe, ddl), "sampled")


def telling_features(rows: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Per label (y, t) and fold left out (-1: none) the features that tell most of it, ascending.

    Rows are counted by feature on the executors. The features of one fit are the
    ``FEATURES`` of the largest likelihood ratio, if that is above ``LEAST_GAIN``;
    features of a single text are left out. Only their numbers reach the driver.
    """
    labelled = rows.where("not pool")
    count = lambda label, fold, ones: F.count_if(
        (F.col(label) > 0 if ones else F.col(label) >= 0) & (F.col("fold") == fold)).alias(f"{label}{fold}{int(ones)}")
    cells = [count(label, fold, ones) for label in "yt" for fold in range(FOLDS) for ones in (False, True)]
    total = labelled.agg(*cells).first()
    by_id = labelled.select("y", "t", "fold", F.explode("ids").alias("id")).groupBy("id").agg(*cells)

    def gain(label: str, left_out: int) -> F.Column:
        used = [f for f in range(FOLDS) if f != left_out]
        c, c1 = (sum((F.col(f"{label}{f}{ones}") for f in used), F.lit(0)).cast("double") for ones in (0, 1))
        n, n1 = (float(sum(total[f"{label}{f}{ones}"] for f in used)) for ones in (0, 1))
        parts = ((c1, c, n1), (c - c1, c, n - n1), (n1 - c1, n - c, n1), (n - n1 - c + c1, n - c, n - n1))
        tiny = F.lit(1e-12)
        value = sum((2 * cell * F.log(F.greatest(cell, tiny) * n / F.greatest(row * column, tiny)) for cell, row, column in parts), F.lit(0.0))
        return F.struct(F.lit(label).alias("label"), F.lit(left_out).alias("left_out"), F.when(c > 1, value).alias("gain"))

    fits = [(label, k) for label in "yt" for k in (-1, *range(FOLDS)) if total[f"{label}00"] is not None]
    told = by_id.select("id", F.inline(F.array(*[gain(*f) for f in fits]))).where(F.col("gain") > LEAST_GAIN)
    first = Window.partitionBy("label", "left_out").orderBy(F.col("gain").desc(), "id")
    best = told.select("label", "left_out", "id", F.row_number().over(first).alias("at")).where(F.col("at") <= FEATURES).toArrow()
    label, left_out, ids = (best[c].to_numpy() for c in ("label", "left_out", "id"))
    return {f: np.sort(ids[(label == f[0]) & (left_out == f[1])]) for f in fits}


def train(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = 20_000, pool_rows: int = 20_000, rounds: int = 3, seed: int = 5,
) -> Judge:
    """Fit on a seeded sample of about ``labelled_rows`` labelled and ``pool_rows`` unlabelled documents.

    The two bounds are the documented limits of the fit, whatever the size of the
    tables. The sampled rows' word features stay on the executors, where they are
    counted; of a row only the features that some fit uses (at most ``FEATURES`` each)
    and its two views reach the driver. Labels with a null doc_id, or
    null in both labels, are left out; of contradicting labels the worse one counts.
    Without a ``toxic`` column there is no verdict on it.
    """
    spark = prepare(docs.sparkSession)
    for name in ("quality", "toxic"):
        if name not in labels.columns:
            labels = labels.withColumn(name, F.lit(None).cast("int"))
    labels = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    rows = _sampled(docs, labels, labelled_rows, pool_rows, seed)
    if rows.where("not pool").limit(1).count() == 0:
        return Judge()
    told = telling_features(rows)
    # At most ten fits of FEATURES each: a number of 16 bits names one on the driver.
    names = np.unique(np.concatenate(list(told.values()))).astype(np.int64)
    known = {fit: np.searchsorted(names, ids) for fit, ids in told.items()}
    number = np.full(1 << WORD_BITS, -1, np.int32)
    number[names] = np.arange(len(names))
    shared = spark.sparkContext.broadcast(number)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ids, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            at = shared.value[ids]
            live = at >= 0
            kept = np.concatenate([[0], np.cumsum(live)])[bounds]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)), _lists(at[live].astype(np.uint16).view(np.int16), kept)],
                batch.schema.names)

    found = rows.mapInArrow(narrow, extended(rows.drop("ids"), "ids array<smallint>")).toArrow().combine_chunks()
    order = np.lexsort((found["place"].to_numpy(), found["pool"].to_numpy(zero_copy_only=False)))
    y, t, fold, pool = (found[c].to_numpy(zero_copy_only=False)[order] for c in ("y", "t", "fold", "pool"))
    a, b = (np.array(found[c].combine_chunks().flatten()).reshape(len(order), -1)[order] for c in ("a", "b"))
    lists = found["ids"].combine_chunks()
    ids, bounds = _take(lists.values.to_numpy().view(np.uint16), lists.offsets.to_numpy().astype(np.int64), order)
    del found, lists
    pa.default_memory_pool().release_unused()
    some = np.flatnonzero(~pool)
    toxic = cross_fit(WordRows(*_take(ids, bounds, some), fold[some], {k: v for (label, k), v in known.items() if label == "t"}),
                      np.where(t[some] >= 0, t[some] > 0, -1.0).astype(float))
    some = np.concatenate([np.flatnonzero(~pool & (y >= 0)), np.flatnonzero(pool)])
    n = int((~pool & (y >= 0)).sum())
    words = WordRows(*_take(ids, bounds, some), fold[some], {k: v for (label, k), v in known.items() if label == "y"})
    del ids, bounds
    quality = co_train(a[some[:n]], b[some[:n]], (y[some[:n]] > 0).astype(float), a[some[n:]], b[some[n:]], rounds, words=words)
    for words in filter(None, (quality and quality.words, toxic)):
        words.ids = names[words.ids]
    return Judge(quality, quality and quality.words, toxic)


RESULT = ("score", "p_text", "p_page", "accepted", "p_toxic", "toxic")


def scored(docs: DataFrame, model: Judge, keep: list[str], least: float = 0.5) -> DataFrame:
    """``keep`` columns, ``score`` (chance of good quality), ``p_text``, ``p_page``, ``accepted``, ``p_toxic`` and ``toxic``.

    ``accepted`` is the verdict on quality alone. Without a model of quality (no
    labels, or of one class only) every score is null and every row accepted; without
    one of toxicity ``p_toxic`` is null and no row toxic. A null text is judged like
    an empty one, a null in the metadata as a value of its own. Names of the result
    replace columns of the same name.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in RESULT]
    rows = _viewed(docs, keep)
    chance = lambda x: 1 / (1 + np.exp(-x))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            n = batch.num_rows
            made = [pa.nulls(n, pa.float64())] * 3 + [pa.array(np.ones(n, bool)), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool))]
            if judge.quality is not None or judge.toxic is not None:
                a, b, ids, bounds = _views(batch.column(batch.num_columns - 1))
            if judge.quality is not None:
                a = _told(a, judge.words.margin(ids, bounds))
                score = judge.quality.score(a, b)
                sure = [chance(m.logit(x)) for m, x in ((judge.quality.text, a), (judge.quality.page, b))]
                made[:4] = [pa.array(score), *map(pa.array, sure), pa.array(score >= least)]
            if judge.toxic is not None:
                p = chance(judge.toxic.logit(ids, bounds))
                made[4:] = [pa.array(p), pa.array(p >= 0.5)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), *made], [*keep, *RESULT])

    out = extended(rows.drop("_view"), "score double, p_text double, p_page double, accepted boolean, p_toxic double, toxic boolean")
    return rows.mapInArrow(work, out)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id`` and the verdict on every row of ``docs``; see :func:`train` and :func:`scored`."""
    return scored(docs, train(docs, labels), ["doc_id"], least)


def accepted_rows(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, of good quality and not toxic."""
    verdict = "_accepted"
    rows = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    judged = scored(rows, train(docs, labels), ["_row"], least).withColumnRenamed("accepted", verdict)
    return judged.where(F.col(verdict) & ~F.col("toxic")).select("_row.*")
