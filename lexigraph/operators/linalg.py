"""Sparse matrices (i, j, a) and vectors (j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.sources.scratch import dealt


def collapsed(cells: DataFrame, duplicates: str = "collapse") -> DataFrame:
    """One row per cell: the largest of its values, or their sum with ``duplicates='sum'``.

    Most cells occur once, so summing them up before the shuffle would fill tables in the memory of the map tasks for
    nothing: they move as they are, to partitions of bounded size.
    """
    combine = {"collapse": F.max, "sum": F.sum}[duplicates]
    return dealt(cells, "j", "i").groupBy("j", "i").agg(combine("a").alias("a"))


def collapsed_vector(vector: DataFrame) -> DataFrame:
    """One row per entry: the largest of its values."""
    return vector.groupBy("j").agg(F.max("v").alias("v"))


def partial_products(cells: DataFrame, vector: DataFrame, duplicates: str = "collapse") -> DataFrame:
    """i, j, b = a x v: a row for each cell, with 0.0 where the vector has no entry."""
    met = collapsed(cells, duplicates).join(collapsed_vector(vector), "j", "left")
    return met.select("i", "j", (F.coalesce("v", F.lit(0.0)) * F.col("a")).alias("b"))


def row_sums(products: DataFrame) -> DataFrame:
    """i, x; Spark sums within each task before the shuffle."""
    return products.groupBy("i").agg(F.sum("b").alias("x"))


def matvec(cells: DataFrame, vector: DataFrame, duplicates: str = "collapse") -> DataFrame:
    """i, x: the product, with a row for each row that has cells."""
    return row_sums(partial_products(cells, vector, duplicates))


def column_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("j").agg(F.sum("a").alias("s"))


def is_stochastic(cells: DataFrame, tolerance: float = 1e-3) -> bool:
    return column_sums(cells).where(F.abs(F.col("s") - 1.0) > tolerance).isEmpty()


def total(vector: DataFrame, value: str = "x") -> DataFrame:
    return vector.agg(F.sum(value).alias("total"))
