"""The four heads as boosted trees, in every framing.

The delay is predicted as a bucket of its own or relative to the resident's cadence,
and decoded by the fullest window or as the likeliest bucket's representative; the
facility as one of several classes or by ranking the candidates of a sample. A head's
number of rounds is searched on the latest training rows and the head is then fitted
on all of them with exactly that number. Fits share one prepared matrix and run at
the same time.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from originline.operators import boosting as B
from originline.operators import cadence as C
from originline.operators import candidates as K
from originline.operators import heads as M
from originline.operators.delays import delay_grid, fixed_representatives, window_decode
from originline.operators.scoring import log_ratio
from originline.operators.splits import in_tail
from originline.params import HEADS, Params

GAP = "inter_booking_interval_median_days"
FACILITY, DELAY = HEADS[0], HEADS[3]


@dataclasses.dataclass(frozen=True)
class Framing:
    """How the heads are framed, and the size of their fits."""

    delay: str = "absolute"  # or "cadence"
    decode: str = "window"  # or "argmax", of the absolute framing
    facility: str = "classes"  # or "ranking"
    boost: B.Boost = B.Boost()
    search: bool = True

    def __post_init__(self) -> None:
        for value, known in ((self.delay, ("absolute", "cadence")), (self.decode, ("window", "argmax")), (self.facility, ("classes", "ranking"))):
            if value not in known:
                raise ValueError(f"{value!r} is not one of {known}")


@dataclasses.dataclass(frozen=True)
class Fitted:
    """One boosted head, its framing, the searched curve and, for cadence, its calibration."""

    name: str
    classes: tuple[str, ...]
    inputs: tuple[str, ...]
    framing: Framing
    model: B.BoostedModel
    curve: tuple[B.Round, ...] = ()
    calibration: C.CadenceModel | None = None


def ranked(head: str, framing: Framing) -> bool:
    return head == FACILITY and framing.facility == "ranking"


def by_cadence(head: str, framing: Framing) -> bool:
    return head == DELAY and framing.delay == "cadence"


def prepared(table: DataFrame, p: Params, lists: bool = False) -> DataFrame:
    """The feature table with the classifiers' inputs as one array, its gaps nulls again for the cadence.

    With ``lists`` the candidates' inputs are there besides.
    """
    inputs = M.model_inputs(p, M.Settings())
    kept = [c for c in table.columns if c not in inputs]
    rows = table.withColumn("_gap", F.col(GAP))
    more = []
    if lists:
        rows, more = candidate_rows(rows, p, rows.columns), ["candidates"]
    return M.matrix(rows, p, M.Settings()).select(
        *kept, F.col("_gap"), F.array(*[F.col(c).cast("double") for c in inputs]).alias("features"), *more)


def candidate_rows(table: DataFrame, p: Params, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Columns to keep and the candidates' inputs, in catalog order, as one array per sample, made inside the row."""

    def inputs(c: Column, at: Column) -> Column:
        cells = {"candidate_position": at + 1} | K.candidate_flags(p, lambda name: c[name])
        return F.array(*[F.coalesce(cells.get(n, c[n]).cast("double"), F.lit(-1.0)) for n in M.candidate_inputs(p)])

    wide = table.select("*", *K.family_arrays(p))
    wide = wide.select(*table.columns, K.candidate_structs(p).alias("_cells"))
    return wide.select(*keep, F.transform("_cells", inputs).alias("candidates"))


def _together(jobs: Sequence[Callable], most: int = 4) -> list:
    """Results of jobs that run at the same time, in order."""
    if len(jobs) == 1:
        return [jobs[0]()]
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=min(most, len(jobs))) as pool:
        running = [pool.submit(inherit(job)) for job in jobs]
        return [r.result() for r in running]


class Design:
    """Training rows prepared once: matrices with and without the inner fold, for all framings asked for."""

    def __init__(self, rows: DataFrame, p: Params, asked: Sequence[tuple[str, Framing]], borders: list[list[float]] | None = None) -> None:
        """``borders`` of the classifiers' inputs are found if they are not given."""
        self.p = p
        held = in_tail(rows, p.inner_frac)
        self.calibration = C.cadence(p, GAP).fit(rows) if any(by_cadence(h, f) for h, f in asked) else None
        labels = {h: M.label(h, p) for h, f in asked if not ranked(h, f) and not by_cadence(h, f)}
        if self.calibration is not None:
            labels["cadence"] = self.calibration.copy({self.calibration.gapCol: "_gap"}).label()
        most = asked[0][1].boost.borders
        self.wide = B.Matrix(prepared(rows, p), F.col("features"), labels, held, borders or input_borders(rows, p, most)) if labels else None
        self.lists = None
        if any(ranked(h, f) for h, f in asked):
            places = M.candidate_matrix(K.build_candidates(rows, p), p)
            self.lists = B.Matrix(
                candidate_rows(rows, p, ("sample_id", "target_us", "target_facility_id")), F.col("candidates"), {FACILITY: M.label(FACILITY, p)}, held,
                B.find_borders(places, M.candidate_inputs(p), most), width=len(p.names))

    def fit(self, head: str, framing: Framing, rounds: int | None = None) -> Fitted:
        """One head; without ``rounds`` their number is searched, and the fit repeated on all rows."""
        p, own, cad = self.p, ranked(head, framing), by_cadence(head, framing)
        matrix, label = (self.lists, head) if own else (self.wide, "cadence" if cad else head)
        classes = p.names if own else tuple(map(str, range(self.calibration.buckets()))) if cad else M.classes(head, p)
        s = dataclasses.replace(framing.boost, seed=framing.boost.seed + HEADS.index(head))
        curve: list[B.Round] = []
        if rounds is None and framing.search:
            _, _, curve = B.boost(matrix, label, len(classes), s, curve=True)
            rounds = B.best_round(curve)
        s = dataclasses.replace(s, rounds=s.rounds if rounds is None else rounds)
        trees, start, _ = B.boost(_Whole(matrix), label, len(classes), s)
        if len(trees) != s.rounds and matrix_usable(matrix):
            raise RuntimeError(f"{head}: {len(trees)} trees for {s.rounds} rounds")
        model = B.boosted_model(trees, start, matrix.borders, len(classes), own)
        inputs = M.candidate_inputs(p) if own else M.model_inputs(p, M.Settings())
        return Fitted(head, classes, tuple(inputs), framing, model, tuple(curve), self.calibration if cad else None)

    def close(self) -> None:
        for matrix in (self.wide, self.lists):
            if matrix is not None:
                matrix.close()


def input_borders(rows: DataFrame, p: Params, most: int = B.Boost().borders) -> list[list[float]]:
    """Borders of the classifiers' inputs on training rows."""
    return B.find_borders(M.matrix(rows, p, M.Settings()), M.model_inputs(p, M.Settings()), most)


def matrix_usable(matrix: B.Matrix) -> bool:
    return any(matrix.borders)


class _Whole:
    """A matrix seen without its inner fold: every row gives gradients."""

    def __init__(self, matrix: B.Matrix) -> None:
        self.matrix, self.width, self.borders = matrix, matrix.width, matrix.borders

    def counts(self, name: str, classes: int):
        return self.matrix.counts(name, classes, every=True)

    def sums(self, name: str, *how):
        return self.matrix.sums(name, *how, every=True)


#: The other framing of two heads: the head, its column among the answers, what differs.
MORE = {
    "notification_cadence": (DELAY, "cadence_delay_minutes", {"delay": "cadence"}),
    "facility_ranked": (FACILITY, "ranked_facility_id", {"facility": "ranking"}),
}


def fit_more(rows: DataFrame, p: Params, framing: Framing | None = None) -> dict[str, Fitted]:
    """The heads of :data:`MORE`: each framed otherwise than in ``framing``."""
    return fit_heads(rows, p, framing, tuple(MORE))


def planted_label(head: str, p: Params) -> tuple[Column, tuple[str, ...]]:
    """A target that is a plain function of one input, and the inputs that tell it alone."""
    if head == FACILITY:
        names = F.array(*map(F.lit, p.names))
        return F.greatest(F.array_position(names, F.col("last_1_facility")) - 1, F.lit(0)).cast("int"), ("last_1_facility",)
    part = "weekday" if head == "usage_weekday" else "hour"
    target = F.least(F.col(f"origin_{part}"), F.lit(float(len(M.classes(head, p)) - 1))).cast("int")
    return target, (f"origin_{part}", f"origin_{part}_sin", f"origin_{part}_cos", f"last_booking_{part}")


def planted_control(
    train: DataFrame, held: DataFrame, p: Params, borders: list[list[float]] | None = None,
) -> tuple[dict[str, float], dict[str, bool]]:
    """Per head, fitted to a planted target: its accuracy on unseen rows, and whether that input leads its gains."""
    labels = {h: planted_label(h, p) for h in HEADS}
    inputs = M.model_inputs(p, M.Settings())
    kept = lambda rows: prepared(rows.select("*", *[c.alias(f"_y_{h}") for h, (c, _) in labels.items()]), p)
    size = B.Boost(rounds=2, share=1.0)
    matrix = B.Matrix(kept(train), F.col("features"), {h: F.col(f"_y_{h}") for h in HEADS}, F.lit(False),
                      borders or input_borders(train, p, size.borders))
    try:
        fits = _together([lambda h=h: B.boost(matrix, h, len(M.classes(h, p)), size) for h in HEADS])
    finally:
        matrix.close()
    models = {h: B.boosted_model(t, start, matrix.borders, len(M.classes(h, p)), False) for h, (t, start, _) in zip(HEADS, fits, strict=True)}
    scored = kept(held).select(*[f"_y_{h}" for h in HEADS], *[m.probabilities(F.col("features")).alias(f"p_{h}") for h, m in models.items()])
    right = lambda h: F.avg((F.array_position(f"p_{h}", F.array_max(f"p_{h}")) - 1 == F.col(f"_y_{h}")).cast("int")).alias(h)
    rates = scored.agg(*[right(h) for h in HEADS]).first()
    leads = {h: inputs[max(m.gains(), key=lambda x: (x[1], -x[0]))[0]] in labels[h][1] for h, m in models.items()}
    return {h: rates[h] for h in HEADS}, leads


def fit_heads(
    rows: DataFrame, p: Params, framing: Framing | None = None, heads: Sequence[str] = HEADS, borders: list[list[float]] | None = None,
) -> dict[str, Fitted]:
    """Heads of one framing, and of :data:`MORE`, fitted at the same time on one design."""
    base = framing or Framing()
    asked = [(MORE[n][0], dataclasses.replace(base, **MORE[n][2])) if n in MORE else (n, base) for n in heads]
    design = Design(rows, p, asked, borders)
    try:
        done = _together([lambda h=h, f=f: design.fit(h, f) for h, f in asked])
    finally:
        design.close()
    return dict(zip(heads, done, strict=True))


def probabilities(heads: dict[str, Fitted], table: DataFrame, p: Params, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Columns to keep, the cadence's gap, and one array ``p_<head>`` per head."""
    source = {n: "candidates" if ranked(h.name, h.framing) else "features" for n, h in heads.items()}
    rows = prepared(table, p, "candidates" in source.values()).select(*keep, "_gap", *sorted(set(source.values())))
    kept, scorers = [*keep, "_gap"], {n: h.model.scorer() for n, h in heads.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(work(batch.column(source[n])) for n, work in scorers.items())],
                [*kept, *(f"p_{n}" for n in scorers)])

    return rows.mapInArrow(score, StructType([
        *(rows.schema[c] for c in kept), *(StructField(f"p_{n}", ArrayType(DoubleType())) for n in scorers)]))


def delay_of(head: Fitted, probability: Column, p: Params) -> Column:
    """The submitted delay of a density, in the head's framing; ``_gap`` is the row's median gap."""
    if head.calibration is not None:
        model = head.calibration.copy({head.calibration.gapCol: "_gap"})
        return model.decoded(probability)
    if head.framing.decode == "window":
        return F.exp(window_decode(probability, delay_grid(p)))
    place = F.array_position(probability, F.array_max(probability)).cast("int")
    return F.get(F.array(*map(F.lit, fixed_representatives(p))), place - 1)


def answer(name: str, head: Fitted, p: Params) -> Column:
    """What a head submits for its density ``p_<name>``."""
    density = F.col(f"p_{name}")
    if head.name == DELAY:
        return delay_of(head, density, p)
    return M.argmax_class(density, head.classes).cast("string" if head.name == FACILITY else "int")


def submitted(heads: dict[str, Fitted], scored: DataFrame, p: Params) -> DataFrame:
    """The answers of the heads that are there, from their staged probabilities; :data:`MORE` are columns of their own."""
    own = {FACILITY: "predicted_facility_id", DELAY: "predicted_delay_minutes"}
    return scored.select("sample_id", *[
        answer(n, h, p).alias(MORE[n][1] if n in MORE else own.get(n, f"predicted_{n}")) for n, h in heads.items()])


def long_probabilities(heads: dict[str, Fitted], table: DataFrame, p: Params) -> DataFrame:
    """Class probabilities in long form: sample, head, class, its position, probability."""

    def cells(name: str, head: Fitted) -> Column:
        names = F.array(*map(F.lit, head.classes))
        return F.transform(F.col(f"p_{name}"), lambda x, i: F.struct(
            F.lit(name).alias("head"), F.get(names, i).alias("class"), i.alias("position"), x.alias("probability")))

    return probabilities(heads, table, p).select("sample_id", F.inline(F.concat(*(cells(n, h) for n, h in heads.items()))))


def predict(heads: dict[str, Fitted], table: DataFrame, p: Params) -> DataFrame:
    """All four answers of every row of a feature table; the targets are not read."""
    if absent := [h for h in HEADS if h not in heads]:
        raise ValueError(f"there is no fitted head for {absent}")
    return submitted(heads, probabilities(heads, table, p), p)


def hit(head: str, answer: Column, p: Params) -> Column:
    """Whether an answer matches its target, in a row that has both."""
    if head == DELAY:
        return F.abs(log_ratio(F.greatest(answer, F.lit(0.0)), F.col("notification_delay_minutes"))) <= p.tolerance
    return answer == F.col("target_facility_id" if head == FACILITY else f"target_{head}")


def likely_hits(heads: dict[str, Fitted], scored: DataFrame, rows: DataFrame, p: Params, k: int = 3) -> DataFrame:
    """``head`` and ``hit`` beside the columns of ``rows``: whether a label is among the k likeliest classes, ties by class order.

    For the report's ``likely``; heads of the delay are left out.
    """

    def hit(name: str, label: Column) -> Column:
        ordered = F.sort_array(F.transform(F.col(f"p_{name}"), lambda x, i: F.struct(x.alias("p"), (-i).alias("o"))), asc=False)
        return F.exists(F.slice(ordered, 1, k), lambda e: -e["o"] == label)

    cells = [
        F.struct(F.lit(name).alias("head"), hit(name, M.label(head.name, p).cast("int")).alias("hit"))
        for name, head in heads.items() if head.name != DELAY
    ]
    return scored.join(rows, "sample_id").select(*[c for c in rows.columns if c != "sample_id"], F.inline(F.array(*cells)))


def gains(heads: dict[str, Fitted], spark: SparkSession, top: int = 20) -> DataFrame:
    """The features of every head whose cuts move its margins most; a model-sized table."""
    rows = []
    for name, head in heads.items():
        best = sorted(((head.inputs[f], g) for f, g in head.model.gains()), key=lambda x: (-x[1], x[0]))
        rows += [(name, i + 1, f, g) for i, (f, g) in enumerate(best[:top])]
    return spark.createDataFrame(rows, "head string, rank int, feature string, gain double")


def curves(heads: dict[str, Fitted], spark: SparkSession) -> DataFrame:
    """The searched validation curves: one row per head and round, with the rounds the head was fitted with."""
    rows = [(n, r.rounds, r.rows, r.hits, r.loss / max(r.rows, 1), h.model.rounds) for n, h in heads.items() for r in h.curve]
    return spark.createDataFrame(rows, "head string, round int, rows long, hits long, loss double, fitted int")


# -------------------------------------------------------------------- save, load


def save(heads: dict[str, Fitted], spark: SparkSession, folder: str) -> None:
    """Every head with its calibration, by the ML writers; then a table that names them."""
    rows = []
    for name, head in heads.items():
        head.model.write().overwrite().save(f"{folder}/{name}/model")
        if head.calibration is not None:
            head.calibration.write().overwrite().save(f"{folder}/{name}/calibration")
        rows.append((name, list(head.classes), list(head.inputs), json.dumps(dataclasses.asdict(head.framing)), head.calibration is not None,
                     [dataclasses.astuple(r) for r in head.curve]))
    frame = spark.createDataFrame(
        rows, "name string, classes array<string>, inputs array<string>, framing string, calibrated boolean, "
        "curve array<struct<rounds:int,rows:long,hits:long,loss:double>>")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/heads")


def load(spark: SparkSession, folder: str) -> dict[str, Fitted]:
    """What :func:`save` wrote, in the declared order; a missing part is an error."""
    found = {}
    for row in spark.read.parquet(f"{folder}/heads").collect():  # one row a head
        parts = json.loads(row["framing"])
        framing = Framing(**{**parts, "boost": B.Boost(**parts["boost"])})
        calibration = C.CadenceModel.load(f"{folder}/{row['name']}/calibration") if row["calibrated"] else None
        found[row["name"]] = Fitted(
            MORE[row["name"]][0] if row["name"] in MORE else row["name"], tuple(row["classes"]), tuple(row["inputs"]), framing, B.BoostedModel.load(f"{folder}/{row['name']}/model"),
            tuple(B.Round(*r) for r in row["curve"]), calibration)
    return {h: found[h] for h in (*HEADS, *MORE) if h in found}


# ---------------------------------------------------------------------- variants


@dataclasses.dataclass(frozen=True)
class Variant:
    """One setting changed against the frozen framing, and the heads it concerns."""

    priority: int
    name: str
    change: dict
    heads: tuple[str, ...]

    @property
    def fits(self) -> int:
        return len(self.heads)

    def framing(self, frozen: Framing) -> Framing:
        """The frozen framing with this one change."""
        own = {k: v for k, v in self.change.items() if k in ("delay", "decode", "facility")}
        size = {k: v for k, v in self.change.items() if k not in own}
        return dataclasses.replace(frozen, **own, boost=dataclasses.replace(frozen.boost, **size))


CLASSIFIERS = HEADS[:3]
DECLARED = (
    Variant(1, "cadence_delay", {"delay": "cadence"}, (DELAY,)),
    Variant(2, "likeliest_bucket", {"decode": "argmax"}, (DELAY,)),
    Variant(3, "ranked_facility", {"facility": "ranking"}, (FACILITY,)),
    Variant(4, "deeper_trees", {"depth": 4}, CLASSIFIERS),
    Variant(5, "slower_rate", {"rate": 0.15}, CLASSIFIERS),
    Variant(6, "stronger_leaves", {"l2": 10.0}, CLASSIFIERS),
)


def plan(budget: int, declared: Sequence[Variant] = DECLARED) -> tuple[list[Variant], list[Variant]]:
    """Variants in order of priority as far as the fits go, and the rest from the first that does not fit.

    The rest is for a plan of its own: :func:`run_variants` goes on with it.
    """
    ordered, spent = sorted(declared, key=lambda v: v.priority), 0
    for i, variant in enumerate(ordered):
        spent += variant.fits
        if spent > budget:
            return ordered[:i], ordered[i:]
    return ordered, []


def run_variants(
    train: DataFrame, validation: DataFrame, p: Params, frozen: dict[str, Fitted], budget: int = 8, declared: Sequence[Variant] = DECLARED,
    borders: list[list[float]] | None = None,
) -> DataFrame:
    """All declared variants on one design: their match rates beside the frozen heads'.

    A variant refits only the heads it names, with as many rounds as the frozen head
    has, so that nothing but the declared setting differs; one that only decodes
    otherwise takes the frozen head's trees. ``budget`` fits are planned at a time, in
    order of priority, until no variant is left.
    """
    base = next(iter(frozen.values())).framing
    fits = [(h, f) for v in declared for h in v.heads if _refits(f := v.framing(base), base)]
    design = Design(train, p, fits, borders) if fits else None
    done: dict[tuple[str, str], Fitted] = {}
    rest = sorted(declared, key=lambda v: v.priority)
    try:
        while rest:
            chosen, later = plan(budget, rest)
            if not chosen:  # one variant of more fits than the budget still runs
                chosen, later = rest[:1], rest[1:]
            rest = later
            tasks = [(v, h) for v in chosen for h in v.heads]
            fitted = _together([lambda v=v, h=h: _variant_head(design, v.framing(base), frozen[h]) for v, h in tasks])
            done |= {(v.name, h): model for (v, h), model in zip(tasks, fitted, strict=True)}
    finally:
        if design is not None:
            design.close()
    ordered = sorted(declared, key=lambda v: v.priority)
    touched = {h: frozen[h] for h in HEADS if any(h in v.heads for v in declared)}
    rates = _rates([*touched.values(), *done.values()], validation, p)
    before, after = dict(zip(touched, rates[:len(touched)], strict=True)), dict(zip(done, rates[len(touched):], strict=True))
    out = [(v.name, v.priority, h, done[v.name, h].model.rounds, "done", after[v.name, h], before[h]) for v in ordered for h in v.heads]
    return train.sparkSession.createDataFrame(
        out, "variant string, priority int, head string, rounds int, state string, rate double, frozen_rate double")


def _refits(framing: Framing, frozen: Framing) -> bool:
    """Whether anything but the decoding of the densities differs."""
    return dataclasses.replace(framing, decode=frozen.decode) != frozen


def _variant_head(design: Design | None, framing: Framing, head: Fitted) -> Fitted:
    if not _refits(framing, head.framing):
        return dataclasses.replace(head, framing=framing)
    return design.fit(head.name, framing, head.model.rounds)


def _rates(heads: Sequence[Fitted], rows: DataFrame, p: Params) -> list[float]:
    """The share of rows that each head's answer matches, all in one pass over the rows."""
    targets = ("target_facility_id", "target_usage_weekday", "target_usage_hour", "notification_delay_minutes")
    named = {f"h{i}": h for i, h in enumerate(heads)}
    scored = probabilities(named, rows, p, targets)
    found = scored.agg(*[F.avg(hit(h.name, answer(n, h, p), p).cast("int")).alias(n) for n, h in named.items()]).first()
    return [float(found[n]) if found[n] is not None else math.nan for n in named]
