"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut into chunks at places that its own characters choose, so equal passages give equal chunks wherever they
stand. Each distinct chunk moves over the network once, to be checked against all others of its 64-bit fingerprint;
a fingerprint that one chunk alone owns is a verified identifier. A document is then only the ordered list of its
chunks' identifiers, its recipe, and documents are equal exactly if their recipes are. Long texts never meet.

Equality: texts are compared after each run of ASCII white space became one space; null counts as empty. Empty texts
equal each other. Null ids sort last. Rows that repeat an id with an equal text are copies too, and one of them stays.
An empty table gives an empty result. A very long text is a list of chunks of at most 4,096 characters. Columns other
than the id and the text are not read; ``deduplicated`` returns them as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.scratch import materialise, table

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk has 128 to 4,096 characters and ends at a space whose neighbours are of the two classes, about one in sixty.
CHUNK = r"(?s).{128,4096}?(?:(?<=[dgklmwy.!?]\x20)(?=[bcfgjkpqvwxzBCFGJKPQVWXZ])|\z)|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text, which they make up without gaps; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    ``fingerprint`` may be weak: chunks that share a value are told apart by their characters.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("t"))
    prints = lambda column: F.transform(chunks(column), lambda c: fingerprint(c))
    recipes = materialise(
        source.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.sha2("t", 256).alias("text_sha256"),
            prints(F.col("t")).alias("recipe"),
        ),
        "recipes",
    )
    pieces = source.select(F.explode(chunks(F.col("t"))).alias("chunk")).select(fingerprint(F.col("chunk")).alias("print"), "chunk")
    distinct = pieces.distinct()
    shared = materialise(distinct.groupBy("print").count().where("count > 1").select("print"), "shared-prints")
    if shared.isEmpty():
        recipes = recipes.withColumn("variants", F.array().cast("array<int>"))
    else:
        recipes = _told_apart(source, recipes, distinct, shared, fingerprint)

    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_id"))
    groups = recipes.groupBy("recipe", "variants").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    # Copies are few or in few groups: the side of the groups is small, and a hot group splits on the documents' side.
    joined = recipes.join(groups, ["recipe", "variants"], "left")
    alone = F.isnull("n")
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row_id") == F.col("row_id"))).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def _told_apart(source: DataFrame, recipes: DataFrame, distinct: DataFrame, shared: DataFrame, fingerprint: Callable) -> DataFrame:
    """Recipes with the numbers, in order, of those chunks whose fingerprint several chunks share."""
    by_print = Window.partitionBy("print").orderBy("chunk")
    numbers = distinct.join(shared, "print", "left_semi").withColumn("variant", F.row_number().over(by_print))
    placed = (
        source.select(F.sha2("t", 256).alias("text_sha256"), F.posexplode(chunks(F.col("t"))).alias("pos", "chunk"))
        .withColumn("print", fingerprint(F.col("chunk")))
        .join(shared, "print", "left_semi")
        .join(numbers, ["print", "chunk"])
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "variant"))).alias("placed"))
    )
    variants = F.coalesce(F.col("placed.variant"), F.array().cast("array<int>"))
    return recipes.join(placed, "text_sha256", "left").withColumn("variants", variants).drop("placed")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that repeat the text of another row; all columns as they were."""
    found = exact_duplicates(docs, text, doc_id)
    pair = lambda side: [F.col("doc_id").alias(f"__{side}_id"), F.col("text_sha256").alias(f"__{side}_sha")]
    gone = materialise(found.where("not kept").select(*pair("gone")).distinct(), "copies")
    stays = found.where("kept").select(*pair("stays"))
    same = F.col("__gone_id").eqNullSafe(F.col("__stays_id")) & (F.col("__gone_sha") == F.col("__stays_sha"))
    repeated = materialise(gone.join(stays, same, "left_semi"), "repeated-rows")

    digest = F.sha2(normalised(F.col(text)), 256)
    copy = F.col(doc_id).eqNullSafe(F.col("__gone_id")) & (digest == F.col("__gone_sha"))
    # The copies are a share of the documents, so their table is never broadcast; its keys are unique, and hashing it
    # partition by partition spares sorting the texts.
    clean = docs.join(gone.hint("shuffle_hash"), copy, "left_anti")
    if repeated.isEmpty():
        return clean
    # Rows that share both id and text can't be told apart by either: of these, any one stays.
    again = docs.join(repeated, copy, "left_semi").withColumn("__sha", digest)
    return clean.unionByName(again.dropDuplicates([doc_id, "__sha"]).drop("__sha"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id,
       min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from d
"""
