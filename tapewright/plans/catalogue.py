"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from tapewright.plans import checks, extra, joins, measures, models, more_sql, recursions, strategies, studies, windows

MODULES = (windows, recursions, joins, measures, checks, models, extra, studies, strategies)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in (*MODULES, more_sql) for k, v in m.SQL.items()}
