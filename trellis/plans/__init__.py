"""Plans: registered queries on the driver's tables, comparisons and scenarios."""

from trellis.plans.registry import ORACLES, QUERIES


def load_all():
    """Import every query module so the registry is filled; return it."""
    from trellis.plans import (q_classify, q_holdout, q_linear, q_models,  # noqa: F401
                               q_runlog, q_summary, q_tables)
    return QUERIES, ORACLES
