"""Mixing sources to target weights by repetition.

Word counts are summed per source, targets are derived from weights under a cap, and the ratio of a source's target to
its size is its rate. A document is emitted floor(rate) times, and once more if a number in [0, 1) hashed from the
seed and its id lies under the rate's fraction. So a document's copies depend on its own row and its source's rate
alone: a rerun, another partitioning or a lost executor gives the same copies.

Null texts have size 0, a null source is a source of its own (last in order), ids that repeat get the same copies.
A source without words gets no copies. An empty table gives an empty mix. Very long texts are only counted, where they
stand; rows that repeat are rows of their own. Further columns may have any name: ``mixed`` returns them as they were,
``plan_mix`` doesn't read them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.scratch import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
#: 13 hex digits of an MD5 are 52 bits, which a double holds exactly.
DIGITS, SCALE = 13, float(16**13)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id; null ids share one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(SCALE)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, size).

    The weights repeat over the sources in order of code points. Both the ranks and the resharing work on the
    distributed table of sources; the driver holds row counts of partitions and two sums a round.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ranks without one sorted partition: range partitions, ranks within each, and the counts of those before.
    placed = totals.repartitionByRange(F.isnull("source"), F.col("source")).sortWithinPartitions(F.isnull("source"), "source")
    placed = materialise(
        placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sources"
    )
    counts = {row["part"]: row["count"] for row in placed.groupBy("part").count().collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    starts = spark.createDataFrame(offsets, "part int, before long")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.col("at") + F.col("before")
    weighed = placed.join(starts, "part").select("source", "source_size", F.get(cycle, (rank % len(weights)).cast("int")).alias("w"))

    # Water level: a source gets min(cap x size, w x level). Raising the level over the sources that are not yet at
    # their cap, until no more of them reach it, is Newton's method on a concave piecewise linear function: it ends.
    most = F.col("source_size") * F.lit(float(cap))
    budget = float(share) * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        reached = F.col("w") * F.lit(level) >= most
        sums = weighed.agg(
            F.sum(F.when(reached, most)).alias("capped"), F.sum(F.when(~reached, F.col("w"))).alias("open"), F.count(F.when(reached, 1)).alias("n")
        ).first()
        if not sums["open"] or sums["n"] == full:
            break
        full, level = sums["n"], max(level, (budget - (sums["capped"] or 0.0)) / sums["open"])
    target = F.least(most, F.col("w") * F.lit(level)) if sums["open"] else F.least(most, F.lit(budget))
    return weighed.select("source", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies."""
    sizes = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    rates = _rates(sizes, weights, share, cap)
    return sizes.join(rates, sizes["source"].eqNullSafe(rates["of"]), "left").select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies(F.col("doc_id"), seed, F.col("rate")).alias("copies")
    )


def _rates(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    targets = materialise(source_targets(sizes, weights, share, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return targets.withColumn("rate", rate).withColumnRenamed("source", "of")


def copies(doc_id: Column, seed: int, rate: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (chance(doc_id, seed) < rate - whole).cast("int")).cast("int")


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay as they are, whatever their names.

    The documents meet the small table of sources only: Spark broadcasts it if it measures under its threshold, else
    it joins by source and splits the hot ones.
    """
    sizes = materialise(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    rates = _rates(sizes, weights, share, cap).select(F.col("of").alias("__mix_of"), F.col("rate").alias("__mix_rate"))
    taken = docs.join(rates, docs[source].eqNullSafe(rates["__mix_of"]), "left")
    number = copies(docs[doc_id], seed, F.col("__mix_rate"))
    again = taken.withColumn("__mix_copy", F.explode(F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>"))))
    return again.select(*[docs[c] for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select source, source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from s
), r as (
  select *, 1.5 * sum(source_size) over ()::double as budget, 2.0 * source_size as most,
         coalesce(sum(2.0 * source_size) over (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as under,
         sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following) as rest
  from w
), l as (
  select arg_min((budget - under) / rest, most / w) filter (where (budget - under) / rest * w <= most) as level from r
), t as (
  select source, source_size, least(most, w * coalesce(level, 1e300)) as target from r, l
), c as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         ('0x' || substr(md5('20:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0 as u
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, round(target, 6) as target,
       (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from c
"""
