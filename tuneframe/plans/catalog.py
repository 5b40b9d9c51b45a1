"""All registered queries."""

from tuneframe.plans import catalog_data, catalog_eval, catalog_runs, catalog_tokens, catalog_train  # noqa: F401
from tuneframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
