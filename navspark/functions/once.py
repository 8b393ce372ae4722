"""Keep costly text expressions from being evaluated several times per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def computed_once(df: DataFrame, names: list[str]) -> DataFrame:
    """Pin the named columns as plain values for everything built on top.

    The optimizer moves a filter below the projection it refers to and copies the
    projected expression into it, once per mention. For parsed text that multiplies
    regular expressions and splits, and can outgrow what code generation compiles.
    A generator of exactly one row is transparent to the data but not to that rewrite.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names))))
