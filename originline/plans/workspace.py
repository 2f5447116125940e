"""The stage tables of one run, built once each and read by later stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originline.operators import delays as D
from originline.operators import framings as B
from originline.operators import habits as H
from originline.operators import prompts as G
from originline.operators import samples as S
from originline.operators import splits as P
from originline.operators.community import community_features, community_reach
from originline.operators.features import feature_table, table_columns
from originline.operators.history import History, build_history, prepare, resident_features
from originline.operators.scoring import score
from originline.params import HEADS, TEST, Params
from originline.session import configure, freeze, new_folder
from originline.sources import binding


class Heads(Mapping):
    """The fitted heads by name, each fitted when it is first asked for."""

    def __init__(self, fit: Callable[[Sequence[str]], dict[str, B.Fitted]]) -> None:
        self.fit, self.done = fit, {}

    def named(self, names: Sequence[str]) -> dict[str, B.Fitted]:
        """Some of them; those that are not there yet are fitted together."""
        if absent := [n for n in names if n not in self.done]:
            self.done |= self.fit(absent)
        return {n: self.done[n] for n in names}

    def __getitem__(self, name: str) -> B.Fitted:
        if name not in (*HEADS, *B.MORE):
            raise KeyError(name)
        return self.named([name])[name]

    def __iter__(self) -> Iterator[str]:
        return iter((*HEADS, *B.MORE))

    def __len__(self) -> int:
        return len(HEADS) + len(B.MORE)


class Workspace:
    """Lazily built stage tables over one folder of inputs."""

    def __init__(self, spark: SparkSession, folder: str, params: Params = TEST) -> None:
        self.spark = configure(spark)
        self.folder = folder
        self.params = params

    def table(self, name: str) -> DataFrame:
        return binding.table(self.spark, self.folder, name)

    @cached_property
    def bookings(self) -> DataFrame:
        return binding.event_bookings(self.spark, self.folder)

    @cached_property
    def orders(self) -> DataFrame:
        return binding.order_bookings(self.spark, self.folder)

    @cached_property
    def roster(self) -> DataFrame:
        return binding.roster(self.spark, self.folder)

    @cached_property
    def prepared(self) -> DataFrame:
        return prepare(self.bookings, self.params)

    @cached_property
    def history(self) -> History:
        return build_history(self.bookings, self.params)

    @cached_property
    def resident(self) -> DataFrame:
        return resident_features(self.history)

    @cached_property
    def community(self) -> DataFrame:
        return community_features(self.prepared, self.params)

    @cached_property
    def community_reach(self) -> DataFrame:
        return community_reach(self.prepared, self.params)

    @cached_property
    def features(self) -> DataFrame:
        """The staged feature table, for queries that read it more than once."""
        return self.model_rows.select(*table_columns(self.params))

    def feature_rows(self) -> DataFrame:
        """The feature table for a query that reads it once: nothing is staged for it."""
        if "model_rows" in self.__dict__:
            return self.features
        return feature_table(self.samples, self.resident, self.community, self.params)

    @cached_property
    def samples(self) -> DataFrame:
        return freeze(S.build_samples(self.history))

    @cached_property
    def cutoffs(self) -> DataFrame:
        return P.cutoffs(self.samples, self.params)

    @cached_property
    def splits(self) -> DataFrame:
        return freeze(P.assign_split(self.samples, self.cutoffs))

    @cached_property
    def split_samples(self) -> DataFrame:
        return freeze(P.with_split(self.samples, self.cutoffs))

    @cached_property
    def train(self) -> DataFrame:
        return self.split_samples.filter("split = 'train'")

    @cached_property
    def holdout(self) -> DataFrame:
        return self.split_samples.filter("split = 'test'")

    @cached_property
    def comparison(self) -> DataFrame:
        p = self.params
        return freeze(P.seeded_draw(self.holdout, p.comparison_rows, p.seed))

    @cached_property
    def history_rows(self) -> DataFrame:
        return self.history.real(self.history.frame)

    @cached_property
    def fallbacks(self) -> DataFrame:
        # No neighbours are read here, so the bookings need not be dealt by resident.
        return freeze(H.fit_fallbacks(self.prepared, self.train))

    @cached_property
    def transitions(self) -> DataFrame:
        return freeze(H.fit_transitions(self.history_rows, self.train))

    @cached_property
    def predictions(self) -> DataFrame:
        return freeze(
            H.predict(self.samples, self.origin_rows(), self.fallbacks, self.transitions)
        )

    @cached_property
    def scored(self) -> DataFrame:
        return freeze(
            score(self.predictions.join(self.split_samples, "sample_id"), self.params)
        )

    @cached_property
    def scored_holdout(self) -> DataFrame:
        return self.scored.filter("split = 'test'")

    @cached_property
    def merged_ladder(self) -> tuple[D.Ladder, list[D.Merge]]:
        counted = D.counted(self.train, D.fine_ladder(self.params))
        return D.merged(counted, self.params.bucket_min_rows)

    @cached_property
    def ladder(self) -> D.Ladder:
        return D.resolved(self.train, self.merged_ladder[0], self.params)

    @cached_property
    def delay_mode(self) -> DataFrame:
        logs = self.train.select(F.log("notification_delay_minutes").alias("x"))
        return freeze(D.window_mode(logs, "x", self.params.tolerance))

    @cached_property
    def prompts(self) -> DataFrame:
        summary = G.prompt_summary(self.samples, self.origin_rows(), self.params)
        return G.render_prompts(summary, self.ladder, self.params)

    @cached_property
    def prompt_rows(self) -> DataFrame:
        return freeze(
            G.rendered_dataset(self.split_samples, self.origin_rows(), self.ladder, self.params)
        )

    @cached_property
    def model_rows(self) -> DataFrame:
        """Features with split and targets: what the classifiers are fitted on."""
        targets = (
            "split", "target_us", "target_facility_id", "target_usage_weekday",
            "target_usage_hour", "notification_delay_minutes",
        )
        return freeze(
            feature_table(self.split_samples, self.resident, self.community, self.params, targets)
        )

    @cached_property
    def input_borders(self) -> list[list[float]]:
        """Borders of the classifiers' inputs, for all fits on the training rows."""
        return B.input_borders(self.model_rows.filter("split = 'train'"), self.params)

    @cached_property
    def heads(self) -> Mapping[str, B.Fitted]:
        """The four boosted heads in their frozen framing, and the other framings of two of them."""

        def fit(names: Sequence[str]) -> dict[str, B.Fitted]:
            return B.fit_heads(
                self.model_rows.filter("split = 'train'"), self.params, heads=names,
                borders=self.input_borders if set(names) - {"facility_ranked"} else None)

        return Heads(fit)

    def some_heads(self, names: Sequence[str]) -> dict[str, B.Fitted]:
        """Heads that a query reads; no other is fitted for it."""
        return self.heads.named(names) if isinstance(self.heads, Heads) else {n: self.heads[n] for n in names}

    @property
    def base_heads(self) -> dict[str, B.Fitted]:
        """The four boosted heads in their frozen framing."""
        return self.some_heads(HEADS)

    def saved(self, heads: dict[str, B.Fitted]) -> dict[str, B.Fitted]:
        """Heads after a round trip through the shared folder."""
        folder = new_folder(self.spark, "heads")
        B.save(heads, self.spark, folder)
        return B.load(self.spark, folder)

    @cached_property
    def saved_heads(self) -> dict[str, B.Fitted]:
        return self.saved(self.some_heads(tuple(self.heads)))

    @cached_property
    def head_scores(self) -> DataFrame:
        """What the heads give out for every sample: a density each."""
        return freeze(B.probabilities(self.some_heads(tuple(self.heads)), self.features, self.params))

    @cached_property
    def head_answers(self) -> DataFrame:
        return freeze(B.submitted(self.some_heads(tuple(self.heads)), self.head_scores, self.params))

    def scores_of(self, names: Sequence[str]) -> DataFrame:
        """:attr:`head_scores` for a query that reads some heads only; staged."""
        if "head_scores" not in self.__dict__:
            key = tuple(names)
            if key not in self._scores:
                self._scores[key] = freeze(B.probabilities(self.some_heads(names), self.features, self.params))
            return self._scores[key]
        return self.head_scores

    def answers_of(self, names: Sequence[str]) -> DataFrame:
        """:attr:`head_answers` for a query that reads some heads only."""
        if "head_answers" not in self.__dict__:
            return B.submitted(self.some_heads(names), self.scores_of(names), self.params)
        return self.head_answers

    @cached_property
    def _scores(self) -> dict[tuple[str, ...], DataFrame]:
        return {}

    @cached_property
    def planted(self) -> tuple[dict[str, float], dict[str, bool]]:
        train, held = (self.model_rows.filter(F.col("split") == s) for s in ("train", "validation"))
        return B.planted_control(train, held, self.params, self.input_borders)

    @cached_property
    def variants(self) -> DataFrame:
        train, held = (self.model_rows.filter(F.col("split") == s) for s in ("train", "validation"))
        return B.run_variants(train, held, self.params, self.base_heads, borders=self.input_borders)

    def origin_rows(self) -> DataFrame:
        """Resident features of the rows that are an origin, one per sample."""
        return self.resident.filter(
            F.col("next_booking_id").isNotNull() & (F.col("n") >= self.params.min_prior)
        )


_CACHE: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of a session and folder; stages are shared by its queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Workspace(spark, folder)
    configure(spark)
    return _CACHE[key]
