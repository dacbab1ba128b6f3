"""All registered queries of the movement operators, with their SQL."""

from __future__ import annotations

from . import build, cameras, evidence, files, links, motion, people, records, runs, sessions, tracks
from .registry import QUERIES, SQL, Query

FLAGSHIP = "proximity_intervals"
_MODULES = (build, cameras, evidence, files, links, motion, people, records, runs, sessions, tracks)  # importing them registers their queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
