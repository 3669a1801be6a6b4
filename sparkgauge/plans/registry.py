"""All registered queries of the core and their SQL."""

from __future__ import annotations

from sparkgauge.plans import measures, relational

MODULES = [relational, measures]
try:
    from sparkgauge.plans import models

    MODULES.append(models)
except ImportError:
    pass

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
