"""The queries of this package and their SQL twins."""

from __future__ import annotations

import functools
import importlib

from docloom.session import apply_settings

_MODULES = (
    "alignment_queries", "line_queries", "lm_queries", "near_queries", "packing_queries", "quality_queries", "shard_queries", "token_queries", "url_queries",
    "vector_queries", "warc_queries",
)


def _modules():
    return [importlib.import_module(f"docloom.llm.{name}") for name in _MODULES]


def _with_settings(fn):
    @functools.wraps(fn)
    def run(spark, sf):
        apply_settings(spark)
        return fn(spark, sf)

    return run


def queries() -> dict:
    return {name: _with_settings(fn) for m in _modules() for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
