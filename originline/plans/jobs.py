"""Every registered job; importing the modules fills the registry."""

from originline.plans import (  # noqa: F401
    features,
    models,
    ranking,
    review,
    scoring,
    tables,
)
from originline.plans.registry import JOBS, ORACLES  # noqa: F401
