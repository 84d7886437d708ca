"""Registry of every query job: name -> (spark, sf_dir) -> DataFrame, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlweave.sources.tables import Tables


def _wrap(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sqlweave.operators import shapes
    out = {k: _wrap(f) for k, f in shapes.SHAPES.items()}
    for mod in _job_modules():
        out.update({k: _wrap(f) for k, f in mod.QUERIES.items()})
    return out


def all_sql() -> dict[str, str]:
    from sqlweave.operators import shapes
    out = dict(shapes.SQL)
    for mod in _job_modules():
        out.update(mod.SQL)
    return out


def _job_modules():
    import importlib
    mods = []
    for name in ("catalog_jobs", "path_jobs", "text_jobs", "corpus_jobs", "check_jobs",
                 "module_jobs", "discover_jobs", "synth_jobs"):
        try:
            mods.append(importlib.import_module(f"sqlweave.plans.{name}"))
        except ModuleNotFoundError as e:
            if e.name != f"sqlweave.plans.{name}":
                raise
    return mods
