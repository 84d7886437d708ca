"""sqlweave: catalog, query-shape, corpus and SQL-check jobs on Spark DataFrames.

Subpackages
-----------
sources    table loading, raw dictionary rows, persistence (JSON / parquet)
functions  column expressions (text rules, dates, literals, tokens)
operators  the jobs: shapes, catalog, paths, specs, link, lint, compare, synth, bpe
plans      spec rendering to SQL text and questions, paraphrase frames
llm        training-data operators (optional)
"""

from sqlweave.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
