"""Text files and lines as typed rows, and rows as text files.

Parsing fails on lines that don't hold what is asked for (ANSI casts), as the formats promise well-formed input.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The document of this repository that lists the default stop words.
FIXTURES = Path(__file__).resolve().parents[2] / "FIXTURES.md"


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value: the lines of one or several text files or folders, as one input."""
    return spark.read.text(list(paths))


# Key and value


def key_of(line: Column) -> Column:
    """The part before the first tab, the whole line if it has none."""
    return F.substring_index(line, "\t", 1)


def value_of(line: Column) -> Column:
    """The part after the first tab, empty if the line has none."""
    return F.when(F.instr(line, "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise("")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """row_id, title, content: one document a line, title and content apart by the first tab; blank lines count too."""
    rows = lines(spark, path)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), key_of(F.col("value")).alias("title"), value_of(F.col("value")).alias("content"))


def write_pairs(rows: DataFrame, path: str, key: str, value: str, ordered: bool = False, one_file: bool = False) -> None:
    """``key``, tab, ``value`` a line.

    ``ordered`` sorts by key over all files, which are ranges of keys in the order of their names; ``one_file`` makes
    one sorted file in one task, for results that fit it.
    """
    rows = rows.orderBy(key) if ordered or one_file else rows
    rows = rows.coalesce(1) if one_file else rows
    rows.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.text(path)


# Edges, matrices, vectors


def _fields(line: Column) -> Column:
    return F.split(line, r"\s+")


def parse_edges(rows: DataFrame, kind: str = "int", value: str = "value") -> DataFrame:
    """src, dst of lines ``src dst``; further fields are ignored."""
    parts = _fields(F.col(value))
    return rows.select(parts[0].cast(kind).alias("src"), parts[1].cast(kind).alias("dst"))


def parse_matrix(rows: DataFrame, value: str = "value", exact: bool = True) -> DataFrame:
    """i, j, a of the lines with exactly three fields, or with three or more, shorter ones being left out."""
    parts = _fields(F.col(value))
    cells = rows.where(F.size(parts) == 3 if exact else F.size(parts) >= 3)
    return cells.select(parts[0].cast("int").alias("i"), parts[1].cast("int").alias("j"), parts[2].cast("double").alias("a"))


def parse_vector(rows: DataFrame, value: str = "value") -> DataFrame:
    """j, v of all lines that are no matrix cell, by their first two fields."""
    parts = _fields(F.col(value))
    return rows.where(F.size(parts) != 3).select(parts[0].cast("int").alias("j"), parts[1].cast("double").alias("v"))


def matrix_lines(cells: DataFrame, i: str = "i", j: str = "j", a: str = "a") -> DataFrame:
    """Cells as lines ``i j a``."""
    return cells.select(F.concat_ws(" ", F.col(i).cast("string"), F.col(j).cast("string"), F.col(a).cast("string")).alias("value"))


def write_matrix(cells: DataFrame, path: str) -> None:
    matrix_lines(cells).write.text(path)


# Index


def index_lines(index: DataFrame) -> DataFrame:
    """term, rendered: ``title:weight`` of each posting, tabs between."""
    one = lambda p: F.concat_ws(":", p["title"].cast("string"), p["weight"].cast("string"))
    return index.select("term", F.array_join(F.transform("postings", one), "\t").alias("rendered"))


def write_index(index: DataFrame, path: str, ordered: bool = False, one_file: bool = False) -> None:
    write_pairs(index_lines(index), path, "term", "rendered", ordered, one_file)


def parse_index(rows: DataFrame, value: str = "value") -> DataFrame:
    """term, postings of rendered index lines; a posting is cut at its last colon, so titles may hold colons."""
    parts = F.split(F.col(value), "\t")
    one = lambda x: F.struct(
        F.regexp_replace(x, r":[^:]*$", "").alias("title"), F.substring_index(x, ":", -1).cast("double").alias("weight")
    )
    return rows.select(parts[0].alias("term"), F.transform(F.slice(parts, 2, F.size(parts)), one).alias("postings"))


def parse_postings(rows: DataFrame, value: str = "value") -> DataFrame:
    """term, title, weight: ``parse_index`` with a row per posting, each parsed on its own, whatever a line's length."""
    lists = rows.select(key_of(F.col(value)).alias("term"), F.split(F.col(value), "\t").alias("parts"))
    # Outer: for an inner one, Catalyst adds a filter on the array's size, and makes the line once more for it.
    found = lists.select("term", F.posexplode_outer("parts").alias("place", "posting")).where("place > 0")
    weight = F.substring_index("posting", ":", -1)
    title = F.when(F.instr("posting", ":") > 0, F.left("posting", F.length("posting") - F.length(weight) - 1)).otherwise(F.col("posting"))
    return found.select("term", title.alias("title"), weight.cast("double").alias("weight"))


# Stop words


def stop_words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """word: those of a file with one a line; by default those that FIXTURES.md of this repository lists."""
    if path:
        return lines(spark, path).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    return spark.createDataFrame([(w,) for w in listed_words()], "word string")


def listed_words(path: Path = FIXTURES) -> list[str]:
    """The words of the fenced block under the stop-word heading."""
    section = path.read_text(encoding="utf-8").partition("Stop-word list")[2]
    return section.split("```")[1].split()
