"""Registered queries, one or more for each operator, with the SQL that they are held against."""

from __future__ import annotations

from . import files, groups, messages, metrics, packing, relational, scoring, streams  # noqa: F401
from .registry import QUERIES, SQL, Query

FLAGSHIP = "W01_group_advantage"

#: Columns whose SQL gives an exact decimal or a wider integer; they are cast to the type of the query.
CASTS = {
    "E04_custom_score": {"score": "DOUBLE"},
    "E08_rubric_columns": {"score": "DOUBLE"},
    "E10_batched_scores": {"score": "DOUBLE"},
    "W11_mrr_ndcg": {"query_no": "BIGINT"},
    "X03_exact_match": {"status": "DOUBLE"},
    "X05_numeric_accuracy": {"score": "DOUBLE"},
    "X06_choice_contains_overlap": {"choice": "DOUBLE", "contains": "DOUBLE", "overlap": "DOUBLE"},
    "X08_search_score": {"score": "DOUBLE"},
    "X13_format_reward": {"think": "DOUBLE", "react": "DOUBLE"},
    "X29_finance_match": {"score": "DOUBLE"},
    "X36_loss_weights": {"default_weight": "DOUBLE", "last_round": "DOUBLE", "all_weight": "DOUBLE"},
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for name, columns in CASTS.items():
        replaced = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items())
        out[name] = f"SELECT * REPLACE ({replaced}) FROM ({out[name]})"
    return out
