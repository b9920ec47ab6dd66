"""Column handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Each wanted name if the frame has it, else the column at the same
    position, renamed to the wanted name."""
    have = df.columns
    cols = []
    for i, name in enumerate(wanted):
        src = name if name in have else have[i]
        cols.append(F.col(src).alias(name))
    return df.select(*cols)


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that exist (``token_type_ids`` for models without
    segment embeddings, source columns after feature mapping)."""
    return df.drop(*[n for n in names if n in df.columns])


def by_mode(df: DataFrame, mode: str) -> DataFrame:
    """Predict keeps (id, question, title, context); eval adds answers."""
    cols = ["id", "question", "title", "context"]
    if mode == "eval":
        cols.append("answers")
    return df.select(*[c for c in cols if c in df.columns])
