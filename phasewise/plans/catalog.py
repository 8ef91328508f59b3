"""All registered queries."""

from phasewise.plans import flows, imputing, modelling, prep, sampling, transforming  # noqa: F401
from phasewise.plans.registry import QUERIES, SQL  # noqa: F401
