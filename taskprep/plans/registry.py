"""All registered queries (name -> callable(spark, sf_dir)) and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ["text_tasks", "qa_metrics", "structured", "qa_spans", "scores", "task_log", "spec_eval", "token_queries", "candidates", "nested_qa", "packed_specs", "outputs"]


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"taskprep.plans.{m}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
