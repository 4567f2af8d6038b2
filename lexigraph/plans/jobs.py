"""Whole jobs from paths to paths, one call each."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexigraph.operators import graph, index, linalg
from lexigraph.sources import text as files


def build_index(spark: SparkSession, corpus: str, out: str, stop: str | None = None, ordered: bool = True, unique_titles: bool = False) -> None:
    """The inverted index of the documents in ``corpus``, a term a line; ``stop`` is a file of stop words."""
    docs = files.corpus(spark, corpus)
    files.write_index(index.inverted_index(docs, files.stop_words(spark, stop), unique_titles, ordered), out, ordered)


def build_matrix(spark: SparkSession, edges: str, out: str) -> None:
    """The column-stochastic matrix of the graph in ``edges``."""
    files.write_matrix(graph.stochastic_matrix(files.parse_edges(files.lines(spark, edges))), out)


def multiply(spark: SparkSession, matrix: str, vector: str, out: str, duplicates: str = "collapse") -> None:
    """The product of the matrix and the vector, an entry a line; lines are told apart by their fields."""
    rows = files.lines(spark, matrix, vector)
    files.write_pairs(linalg.matvec(files.parse_matrix(rows), files.parse_vector(rows), duplicates), out, "i", "x")


def prune(spark: SparkSession, edges: str, out: str, compat: bool = False) -> None:
    """The graph in ``edges`` without its dead ends."""
    files.write_pairs(graph.remove_dead_ends(files.parse_edges(files.lines(spark, edges)), compat), out, "src", "dst")
