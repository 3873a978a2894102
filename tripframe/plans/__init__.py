"""Query catalog: every operator as a named query plus its DuckDB oracle."""

from tripframe.plans.registry import ORACLE, QUERIES


def load_all():
    """Import every catalog module so their queries register."""
    from tripframe.plans import (  # noqa: F401
        q_clean,
        q_outliers,
        q_profile,
        q_splits,
        q_features,
        q_sequence,
        q_model,
        q_assembly,
        q_io,
    )
    return QUERIES, ORACLE
