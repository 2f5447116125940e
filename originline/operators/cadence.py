"""The cadence framing of the delay head: what a head needs beside its trees.

A delay is taken relative to the resident's own median gap. The calibration, fitted on
training rows, holds what that needs: the offset of residents without a gap, the grid
of residuals and their smoothed marginal. It is a Spark ML estimator and model, whose
parameters are saved and loaded beside the head's.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.operators import delays as D
from originline.params import Params as Settings


class _CadenceParams(Params):
    gapCol = Param(Params._dummy(), "gapCol", "median gap of the resident, in days", TypeConverters.toString)
    delayCol = Param(Params._dummy(), "delayCol", "observed delay, in minutes", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "array of residual probabilities", TypeConverters.toString)
    span = Param(Params._dummy(), "span", "half-width of the modelled residuals", TypeConverters.toFloat)
    step = Param(Params._dummy(), "step", "width of a residual bucket", TypeConverters.toFloat)
    blend = Param(Params._dummy(), "blend", "weight of a row's own density against the marginal", TypeConverters.toFloat)
    ratio = Param(Params._dummy(), "ratio", "scored ratio of delays", TypeConverters.toFloat)

    def take(self, given: dict) -> None:
        """Parameters that were given, over the defaults."""
        self._setDefault(
            gapCol="gap_median_days", delayCol="notification_delay_minutes", probabilityCol="probability",
            span=4.5, step=0.15, blend=0.5, ratio=1.25)
        self._set(**given)

    def geometry(self) -> Settings:
        """The residual grid in the form the delay functions take."""
        return Settings(
            facilities=(), residual_span=self.getOrDefault("span"), residual_step=self.getOrDefault("step"),
            residual_blend=self.getOrDefault("blend"), match_ratio=self.getOrDefault("ratio"))

    def positive(self, delay: Column) -> Column:
        return F.when(delay > 0, delay).otherwise(F.raise_error(F.lit("a delay has no logarithm")).cast("double"))


class Cadence(Estimator, _CadenceParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the fallback offset and the marginal of the residuals."""

    @keyword_only
    def __init__(self, *, gapCol=None, delayCol=None, probabilityCol=None, span=None, step=None, blend=None, ratio=None):
        super().__init__()
        self.take(self._input_kwargs)

    def _fit(self, rows: DataFrame) -> CadenceModel:
        g = self.geometry()
        gap, delay = (F.col(self.getOrDefault(c)) for c in ("gapCol", "delayCol"))
        logs = rows.select(gap.alias("gap"), F.log(self.positive(delay)).alias("x"))
        mode = D.window_mode(logs, "x", g.tolerance).first()
        if mode is None or mode["mode"] is None:
            raise ValueError("there is no row to calibrate on")
        fallback = float(mode["mode"])
        residual = F.col("x") - D.cadence_offset(F.col("gap"), F.lit(fallback))
        shares = D.marginal(logs.select(D.residual_bucket(residual, g).alias("bucket")), "bucket", D.residual_count(g))
        # One row per bucket of the grid, whatever the number of training rows.
        marginal = [r["probability"] for r in shares.orderBy("bucket").collect()]
        return self._copyValues(CadenceModel(fallback=fallback, marginal=marginal))


class CadenceModel(Model, _CadenceParams, DefaultParamsReadable, DefaultParamsWritable):
    """Offsets, residual labels and decoded delays of rows."""

    fallback = Param(Params._dummy(), "fallback", "offset without a gap, in log minutes", TypeConverters.toFloat)
    marginal = Param(Params._dummy(), "marginal", "smoothed shares of the residual buckets", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, gapCol=None, delayCol=None, probabilityCol=None, span=None, step=None, blend=None, ratio=None, fallback=None, marginal=None):
        super().__init__()
        self.take(self._input_kwargs)

    def buckets(self) -> int:
        return len(self.getOrDefault("marginal"))

    def offset(self) -> Column:
        return D.cadence_offset(F.col(self.getOrDefault("gapCol")), F.lit(self.getOrDefault("fallback")))

    def label(self) -> Column:
        """Residual bucket of an observed delay; a delay that is not positive is an error."""
        delay = self.positive(F.col(self.getOrDefault("delayCol")))
        return D.residual_bucket(F.log(delay) - self.offset(), self.geometry())

    def blended(self, probability: Column) -> Column:
        """A row's density drawn towards the marginal; another number of buckets is an error."""
        weight, n = self.getOrDefault("blend"), self.buckets()
        marginal = F.array(*map(F.lit, self.getOrDefault("marginal")))
        mixed = F.zip_with(probability, marginal, lambda p, m: p * weight + m * (1.0 - weight))
        wrong = F.raise_error(F.lit(f"a density does not have {n} buckets")).cast("array<double>")
        return F.when(F.size(probability) == n, mixed).otherwise(wrong)

    def decoded(self, probability: Column) -> Column:
        """The delay whose scored window carries the most mass of the blended density."""
        centre = D.window_decode(self.blended(probability), D.residual_grid(self.geometry()))
        return F.exp(centre + self.offset())

    def _transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``cadence_offset`` and, where densities are there, ``decoded_delay_minutes``."""
        out = rows.withColumn("cadence_offset", self.offset())
        column = self.getOrDefault("probabilityCol")
        return out.withColumn("decoded_delay_minutes", self.decoded(F.col(column))) if column in rows.columns else out


def cadence(p: Settings, gap: str) -> Cadence:
    """The calibration with the settings of a run."""
    if not math.isfinite(p.residual_span) or p.residual_span <= 0 or p.residual_step <= 0:
        raise ValueError("the residual grid needs a positive span and step")
    return Cadence(gapCol=gap, span=p.residual_span, step=p.residual_step, blend=p.residual_blend, ratio=p.match_ratio)
