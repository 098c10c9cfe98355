"""All registered queries and the SQL that states their results."""

from transmuta.plans import q_detect, q_facts, q_lint, q_outliers, q_runs, q_sources, q_tracker  # noqa: F401
from transmuta.plans.base import ORACLES as _SQL, QUERIES, with_ctes

# expanded here, once every module has added its common table expressions
ORACLES = {name: with_ctes(sql) for name, sql in _SQL.items()}

__all__ = ["QUERIES", "ORACLES"]
