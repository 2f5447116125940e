"""Every tunable of the analytics, as plain dataclasses."""

from __future__ import annotations

import dataclasses
import math
import re


@dataclasses.dataclass(frozen=True)
class Facility:
    """One bookable event type of the catalog."""

    name: str
    popularity: float
    open_hour: int = 0
    close_hour: int = 24
    opens_on: str = "1970-01-01"

    @property
    def slug(self) -> str:
        return slug(self.name)


@dataclasses.dataclass(frozen=True)
class Band:
    """A named half-open range of hours."""

    name: str
    open_hour: int
    close_hour: int

    @property
    def slug(self) -> str:
        return slug(self.name)


def slug(name: str) -> str:
    """Column-safe form of a catalog name."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


# The five named parts of the day, weekday names and the text
# spellings of a missing value that a text feature may never hold.
BANDS = (
    Band("night", 0, 6),
    Band("morning", 6, 12),
    Band("afternoon", 12, 17),
    Band("evening", 17, 21),
    Band("late", 21, 24),
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
NULL_SPELLINGS = ("", "nan", "none", "null", "na", "<na>", "n/a", "nat")
MISSING = "__MISSING__"
SPLITS = ("train", "validation", "test")
HEADS = ("facility", "usage_weekday", "usage_hour", "notification")

DAY_US = 86_400_000_000
MINUTE_US = 60_000_000


@dataclasses.dataclass(frozen=True)
class Params:
    """Settings of one run; the defaults are the published ones."""

    facilities: tuple[Facility, ...]
    bands: tuple[Band, ...] = BANDS
    min_prior: int = 1
    train_frac: float = 0.70
    val_frac: float = 0.15
    comparison_rows: int = 500
    prior_windows_days: tuple[int, ...] = (7, 30, 90, 180)
    trend_days: tuple[int, int] = (30, 90)
    community_days: tuple[int, ...] = (30, 90)
    halflife_days: float = 30.0
    recent_slots: int = 3
    rolling_depths: tuple[int, ...] = (3, 5, 10)
    match_ratio: float = 1.25
    support_minutes: tuple[int, ...] = (30, 60, 180)
    history_bins: tuple[int, ...] = (1, 3, 10, 30)
    inner_frac: float = 0.15
    notification_lead_minutes: int = 120
    review_depth: int = 3
    prompt_events: int = 16
    change_min_priors: int = 20
    change_depth: int = 10
    change_threshold: float = 0.25
    bucket_floor_minutes: int = 60
    bucket_ratio: float = 1.5
    bucket_ceiling_days: int = 100
    bucket_min_rows: int = 200
    residual_span: float = 4.5
    residual_step: float = 0.15
    residual_blend: float = 0.5
    sparse_bookings: int = 5
    resamples: int = 2000
    level: float = 0.95
    seed: int = 42
    # A resident with more rows than this is cut into ordered blocks.
    block_rows: int = 262_144
    # Above this many rows a running median leaves the SQL window.
    median_rows: int = 2_048

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.facilities)

    @property
    def slugs(self) -> tuple[str, ...]:
        return tuple(f.slug for f in self.facilities)

    @property
    def tolerance(self) -> float:
        return math.log(self.match_ratio)


def bucket_edges(p: Params) -> list[float]:
    """Edges of the fixed multiplicative delay buckets, in minutes."""
    if p.bucket_ratio > p.match_ratio**2:
        raise ValueError("a delay bucket is wider than the scored tolerance covers")
    top = float(p.bucket_ceiling_days * 24 * 60)
    steps = math.ceil(math.log(top / p.bucket_floor_minutes) / math.log(p.bucket_ratio))
    grown = [p.bucket_floor_minutes * p.bucket_ratio**k for k in range(steps + 1)]
    return [edge for edge in grown if edge < top] + [top]


# The binding of the test tables: five event types stand in for facilities and
# thirty days for two years, so the windows are shorter.
TEST = Params(
    facilities=(
        Facility("click", 0.24, 0, 24),
        Facility("error", 0.22, 6, 22),
        Facility("purchase", 0.20, 8, 20),
        Facility("signup", 0.18, 5, 21, "2024-01-03"),
        Facility("view", 0.16, 7, 23),
    ),
    prior_windows_days=(1, 3, 7, 14),
    trend_days=(3, 7),
    community_days=(3, 7),
    halflife_days=7.0,
    prompt_events=5,
)
