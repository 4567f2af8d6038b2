"""Labelled rows for training, and the split by which a label may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.scratch import materialise


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids whose labels are never learned from; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: Characters of all training texts together, at most: what the driver holds, however long a text is.
TRAINING_CHARS = 64 << 20


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, chars: int = TRAINING_CHARS
) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of at most ``per_class`` rows of each class, and how many each class has in all.

    The rows with the smallest hashes of seed and id are taken, so a rerun takes the same, as long as they have
    ``chars`` characters together at most. Only their ids and texts reach the driver; ids without a document, null
    labels and held-out ids are left out and not counted. Of rows that label one id twice, the larger label counts, of
    documents that share an id, the smallest text.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    usable = materialise(usable, "labels", few=True)
    counts = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = [usable.where(F.col("label") == c).orderBy(place, "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 x per_class rows of two numbers: this bound, and no estimate, allows the broadcast.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    met = materialise(met.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "training", few=True)
    sizes = met.select("doc_id", F.length("text").alias("n"), place.alias("place")).collect()
    taken, total = [], 0
    for row in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        if total + row["n"] <= chars:
            taken.append(row["doc_id"])
            total += row["n"]
    rows = met.collect() if len(taken) == len(sizes) else met.where(F.col("doc_id").isin(taken)).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["label"] for r in rows], counts
