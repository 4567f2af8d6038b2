"""Scalar functions over texts and weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a maximal run of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` reckoned once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def counted(words: Column) -> Column:
    """token, n of each distinct word of an array, in order: the runs of the sorted array."""

    def runs(s: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        return let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), first), lambda starts: pairs(s, starts))

    def pairs(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(s)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a).alias("token"), (b - a).cast("long").alias("n")))

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs)).otherwise(F.array().cast("array<struct<token:string,n:bigint>>"))


def term_frequency(n: Column, length: Column) -> Column:
    return n / length


def inverse_document_frequency(documents: Column, frequency: Column) -> Column:
    """log2 of all documents over those with the term, unsmoothed."""
    return F.log(documents / frequency) / F.log(F.lit(2.0))


def rounded(value: Column, digits: int = 5) -> Column:
    """Half up, by the decimal text of the double."""
    return F.round(value, digits)


def tf_idf(tf: Column, idf: Column, digits: int = 5) -> Column:
    return rounded(tf * idf, digits)


def stripped(text: Column, pattern: str) -> Column:
    """``text`` without all matches of ``pattern``."""
    return F.regexp_replace(text, pattern, "")


def pair(first: Column, second: Column) -> Column:
    """An ordered, hashable pair: structs compare by first, then by second."""
    return F.struct(first.alias("first"), second.alias("second"))


def pair_text(pair: Column) -> Column:
    return F.concat_ws("\t", pair["first"].cast("string"), pair["second"].cast("string"))
