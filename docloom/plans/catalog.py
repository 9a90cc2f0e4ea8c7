"""All registered queries and their SQL twins."""

from __future__ import annotations

import functools

from docloom.plans import queries_blocks, queries_rows, queries_text
from docloom.session import apply_settings

FLAGSHIP = "category_rule_counts"
_MODULES = (queries_text, queries_rows, queries_blocks)


def _with_settings(fn):
    @functools.wraps(fn)
    def run(spark, sf):
        apply_settings(spark)
        return fn(spark, sf)

    return run


def queries() -> dict:
    return {name: _with_settings(fn) for m in _MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
