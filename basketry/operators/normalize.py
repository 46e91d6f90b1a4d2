"""Normalisation with frozen statistics, and checks of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, columns: list[str], population: bool = False) -> dict[str, tuple[float | None, float | None]]:
    """Mean and standard deviation of every column, in one pass; as many numbers as columns reach the driver."""
    std = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("mean", F.avg), ("std", std)))).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in columns}


def apply(df: DataFrame, stats: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Each column c becomes c_norm; 0 where nothing varies."""
    out = [(F.lit(0.0) if not std else (F.col(c) - mean) / std).alias(f"{c}_norm") for c, (mean, std) in stats.items()]
    return df.select(*(c for c in df.columns if c not in stats), *out)


def sin_cos(c: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * math.pi * c / period
    return F.sin(angle), F.cos(angle)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns))


def require_no_nulls(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    row = null_counts(df, [c for c in df.columns if c not in exclude]).first()
    if bad := [c for c, n in row.asDict().items() if n]:
        raise ValueError(f"columns with nulls: {bad}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def binary_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_binary): only 0 and 1 (or null) occur."""
    row = df.agg(*(F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).cast("double").isin(0.0, 1.0)), F.lit(True)).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("is_binary")) for c in columns))).alias("x")).select("x.*")


def class_weight(labels: DataFrame, column: str) -> DataFrame:
    positive = F.sum(F.col(column)).cast("double")
    return labels.agg(F.least(F.lit(50.0), (F.count(F.lit(1)) - positive) / (positive + 1e-6)).alias("weight"))


def apply_to_value(value: float | None, column: str, stats: dict[str, tuple[float | None, float | None]]) -> float:
    """One value in the column's scale; 0 where nothing varies, and for no value, as after filling."""
    mean, std = stats[column]
    return 0.0 if not std or value is None else (value - mean) / std
