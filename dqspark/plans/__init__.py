"""Registered queries over the driver tables and their DuckDB oracle SQL.

Importing this package imports every plan module, which registers its
queries in :data:`dqspark.plans.catalog.QUERIES` / ``ORACLE``.
"""

from dqspark.plans import catalog  # noqa: F401
from dqspark.plans import (  # noqa: F401
    profiling, drift, rules, registry_plans, sync_plans, traces_plans, audit_plans, streaming_plans, payload_plans, rule_text_plans, state_plans, drift_checks,
)
from dqspark.plans.catalog import ORACLE, QUERIES  # noqa: F401
