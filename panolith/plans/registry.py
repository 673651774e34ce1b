"""All registered queries of the engine with their SQL twins."""

from __future__ import annotations

from panolith.plans import (  # noqa: F401  (importing registers)
    queries_catalog,
    queries_detect,
    queries_files,
    queries_functions,
    queries_reports,
    queries_runs,
    queries_tiles,
)
from panolith.plans.register import ORACLE_SQL, QUERIES  # noqa: F401
