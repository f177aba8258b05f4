"""All queries of the library's operators and their SQL."""

from __future__ import annotations

from . import audits, behave, detect, functions, models, report, sources, streams
from .registry import ORACLES, QUERIES, Query

MODULES = (audits, behave, detect, functions, models, report, sources, streams)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
