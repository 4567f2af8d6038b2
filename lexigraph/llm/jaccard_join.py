"""N-gram Jaccard self-join of documents by chosen paths.

Documents are sets of hashed shingles of five words; two are linked if their sets' Jaccard similarity is 0.8 or more.

1. Texts that differ in white space alone are one text from here on. Each text's set gets a minhash sketch.
2. Chosen paths: a run is a random tree. A node chooses each sketch position with probability 1 / (0.8 x positions); a
   set goes to one child for each chosen position, named by its value there, so sets that share the sampled token
   meet. Buckets of up to BUCKET sets are compared by brute force. A larger one first meets its hub, a tile of BUCKET
   of its sets: what is similar to a hub set joins that one's class. If all but BUCKET of its sets are then in one
   class, the bucket is dense; those few are compared with all, and nothing is left to compare, as a class is compared
   exactly in step 3. Other large buckets are split again, up to DEPTH times. A pair of similarity 0.8 survives a level
   as a critical branching process does, from which follows the number of runs for the target recall. What is still
   large after DEPTH levels is compared as a whole, tile by tile, but for pairs within a class and those whose numbers
   of shingles alone rule out 0.8. So work in a bucket is in proportion to its sets at every step but this last one.
3. Similar sketches in a bucket give candidate classes by connected components, with a margin below 0.8 that loses no
   true link. Sets of a candidate class are compared exactly, in tiles of bounded size where the class is large; there
   each set is sent as its symmetric difference to one set of the class, which is all that their similarities take. No
   pair becomes a row. Each text gets the number of its links, and links that span each group give the final classes.

Recall is that of step 2; every link of step 3 is exact. Shingles are of whitespace-separated words as they are; a text
of one to four words is one shingle, and a text without words links to nothing. Null texts are empty. Rows that repeat
an id and a text are copies like others. Null ids come last. An empty table gives an empty result. A very long text is
one set in one task's memory, eight bytes a word. Other columns of the input, whatever their names, are not read, and
``one_of_each`` returns them as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import term_hashes as H
from lexigraph.llm.blocks import sliced, texts
from lexigraph.llm.components import components
from lexigraph.llm.exact_dedup import normalised
from lexigraph.llm.scratch import materialise, table

WORDS, LEAST = 5, 0.8
#: Positions of a sketch; similarity by sketch from which sets are compared exactly (four standard deviations below).
POSITIONS, LOOSE = 128, 0.655
BUCKET, DEPTH, RECALL = 256, 3, 0.99
#: Sets in a tile of a large class, and shingles in all its sets together, on average.
TILE, TILE_SHINGLES = 1024, 1 << 20
SEED = 4


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, if its buckets split ``depth`` times."""
    survives = 1.0
    for _ in range(depth):
        survives = 1 - math.exp(-survives)
    return math.ceil(math.log(1 - recall) / math.log(1 - survives))


def root_positions(runs: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """(run, position) that the roots of all runs choose."""
    chosen = rng.random((runs, POSITIONS)) < 1 / (LEAST * POSITIONS)
    return [(int(r), int(p)) for r, p in zip(*np.nonzero(chosen), strict=True)]


def shingle_sets(rows: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = H.powers(words)[1:]
    for data in H.blocks(rows):
        block = H.Bytes(data)
        starts, ends = block.words(~H.SPACES)
        hashes = H.word_hashes(block.data, starts, ends)
        bounds = block.bounds(starts)
        n = max(0, len(hashes) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += hashes[k : k + n] * factors[k]
        rolled = H.mixed(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            else:  # all its words, and how many, as one shingle
                short = hashes[a:b] * factors[: b - a]
                yield H.mixed(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)


def sketched(docs: DataFrame, text: str, doc_id: str, roots: list[tuple[int, int]], seed: int) -> DataFrame:
    """doc_id, text_key, n (shingles), firsts (values at the roots' positions) and bits (16 of each position's)."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
    wanted = np.array([p for _, p in roots], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, firsts, bits = [], [], []
            for found in shingle_sets(texts(batch.column("t"))):
                least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
                h = (found >> np.uint64(32)).astype(np.uint32)
                for i in range(0, len(h), 4096):
                    least = np.minimum(least, (h[i : i + 4096, None] * a + b).min(axis=0))
                sizes.append(len(found))
                firsts.append(least[wanted].astype(np.int64))
                bits.append((least >> np.uint32(16) ^ least).astype(np.uint16).tobytes())
            made = [pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            columns = [batch.column("doc_id"), batch.column("text_key"), *made]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "firsts", "bits"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), normalised(docs[text]).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("text_key"), "t").mapInArrow(run, f"doc_id {kind}, text_key string, n int, firsts array<long>, bits binary")


# Buckets of chosen paths


def root_paths(reps: DataFrame, roots: list[tuple[int, int]]) -> DataFrame:
    """rep, path: the buckets of the first level."""
    places = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(p).alias("position")) for r, p in roots])
    steps = F.explode(F.arrays_zip(places.alias("at"), F.col("firsts").alias("value"))).alias("step")
    return reps.select("rep", steps).select("rep", F.xxhash64("step.at.run", "step.at.position", "step.value").alias("path"))


def child_paths(buckets: DataFrame) -> DataFrame:
    """rep, path: the buckets that those of ``buckets`` (path, rep, bits) are split into."""
    chance = int((1 << 20) / (LEAST * POSITIONS))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda p: F.pmod(F.xxhash64("path", p), F.lit(1 << 20)) < chance)
    down = buckets.select("rep", "path", "bits", F.explode(chosen).alias("p"))
    return down.select("rep", F.xxhash64("path", "p", F.substring("bits", F.col("p") * 2 + 1, F.lit(2))).alias("path"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that agree in ``keys`` together, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        last = [held[-1].column(k)[-1].as_py() for k in keys] if held else None
        change[0] = last is not None and last != [p[0] for p in parts]
        for p in parts:
            change[1:] |= p[1:] != p[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def similar_sketches(bits: np.ndarray, least: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first row of its component, rows being joined if ``least`` positions agree.

    With ``side``, rows of one side aren't compared with each other, unless it is side 2.
    """
    n = len(bits)
    label = np.full(n, -1)
    rest = np.arange(n)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        rest = rest[label[rest] < 0]
        todo = [first]
        while todo and len(rest):
            row = todo.pop()
            others = rest if side is None or side[row] == 2 else rest[side[rest] != side[row]]
            new = others[(bits[others] == bits[row]).sum(axis=1) >= least]
            if len(new):
                label[new] = first
                rest = rest[label[rest] < 0]
                todo += new.tolist()
    return label


def _bits(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _links(rep: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    linked = np.flatnonzero(label != np.arange(len(label)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], ["a", "b"])


def bucket_links(buckets: DataFrame, reps: DataFrame, loose: float = LOOSE) -> DataFrame:
    """(a, b): links that span what is similar by sketch in each bucket (path, rep)."""
    rows = buckets.select("path", "rep").join(reps.select("rep", "bits"), "rep").repartition("path").sortWithinPartitions("path")
    least = math.ceil(loose * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["path"]):
            if group.num_rows > 1:
                yield from _links(group.column("rep").to_numpy(), similar_sketches(_bits(group), least))

    return rows.mapInArrow(run, "a long, b long").distinct()


def hub_classes(large: DataFrame, bucket: int = BUCKET, loose: float = LOOSE) -> DataFrame:
    """path, rep, size, bits, class, near of each set of the large buckets (path, rep, size, bits).

    near is a set of the bucket's hub that the set is similar to by sketch, class the first hub set of its component
    within the hub; both are null where no hub set is similar. A set meets its own tile and the hub, so a bucket of n
    sets makes about 2 x n rows and bucket x n comparisons.
    """
    tiles = F.ceil(F.col("size") / bucket).cast("int")
    rows = large.withColumn("tiles", tiles).withColumn("home", F.pmod(F.xxhash64("rep", "path"), F.col("tiles")).cast("int"))
    everywhere = F.when(F.col("home") == 0, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("home"))
    rows = rows.select("path", "rep", "size", "bits", "home", F.explode(everywhere).alias("tile"))
    # The hub's rows come in the same order in each tile, so that its classes have the same names.
    rows = rows.repartition("path", "tile").sortWithinPartitions("path", "tile", "home", "rep")
    least = math.ceil(loose * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["path", "tile"]):
            rep, home, bits = group.column("rep").to_numpy(), group.column("home").to_numpy(), _bits(group)
            n, tile = int(np.searchsorted(home, 0, "right")), group.column("tile")[0].as_py()
            label = similar_sketches(bits[:n], least)
            near = np.full(len(rep) - n, -1) if tile else label
            own = np.arange(n, len(rep)) if tile else np.arange(n)
            if tile:
                for h in range(n):
                    open_ = np.flatnonzero(near < 0)
                    near[open_[(bits[own[open_]] == bits[h]).sum(axis=1) >= least]] = h
            found = pa.array(near < 0)
            names = [pa.array(rep[np.maximum(x, 0)] if n else np.zeros(len(own), np.int64)) for x in (label[near] if n else near, near)]
            names = [pc.if_else(found, pa.scalar(None, pa.int64()), x) for x in names]
            kept = group.take(pa.array(own))
            columns = [kept.column(c).combine_chunks() for c in ("path", "rep", "size", "bits")]
            yield pa.RecordBatch.from_arrays([*columns, *names], ["path", "rep", "size", "bits", "class", "near"])

    return rows.mapInArrow(run, "path long, rep long, size long, bits binary, class long, near long")


def rest_links(buckets: DataFrame, bucket: int = BUCKET, loose: float = LOOSE) -> DataFrame:
    """(a, b): links of dense buckets (path, rep, size, bits, main): each set outside the main class is compared with all."""
    tiles = F.ceil(F.col("size") / bucket).cast("int")
    rows = buckets.withColumn("tiles", tiles)
    tile = F.when(F.col("main"), F.array(F.pmod(F.xxhash64("rep", "path"), F.col("tiles")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("path", "rep", "bits", F.when(F.col("main"), 0).otherwise(2).alias("side"), F.explode(tile).alias("tile"))
    rows = rows.repartition("path", "tile").sortWithinPartitions("path", "tile")
    least = math.ceil(loose * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["path", "tile"]):
            side = group.column("side").to_numpy()
            if side.any() and len(side) > 1:
                yield from _links(group.column("rep").to_numpy(), similar_sketches(_bits(group), least, side))

    return rows.mapInArrow(run, "a long, b long").distinct()


def whole_links(buckets: DataFrame, reps: DataFrame, bucket: int = BUCKET, loose: float = LOOSE) -> DataFrame:
    """(a, b): links between the classes of large buckets (path, rep, class), all of whose sets are compared.

    A bucket is cut into cells by size band, and a class that fills more than a tile of a band has a cell of its own.
    Sets of similarity LEAST are in the same band or in neighbours; cells of one class need no comparison.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / LEAST + 1e-6)).cast("int").alias("band")
    rows = buckets.select("path", "rep", F.coalesce("class", "rep").alias("class")).join(reps.select("rep", band), "rep")
    keys = ["path", "band", "class"]
    counts = materialise(rows.groupBy(*keys).agg(F.count("*").alias("k")), "large-cells", few=True)
    own = counts.where(F.col("k") > bucket).select(*keys, F.col("class").alias("cell"))
    rows = materialise(rows.join(own, keys, "left").withColumn("cell", F.coalesce("cell", F.lit(-1))).drop("class"), "large-buckets", few=True)
    cells = rows.groupBy("path", "band", "cell").agg(F.ceil(F.count("*") / bucket).cast("int").alias("tiles"))
    cells = materialise(cells, "cells", few=True)
    near = cells.withColumnsRenamed({"band": "other_band", "cell": "other_cell", "tiles": "other_tiles"})
    apart = (F.abs(F.col("band") - F.col("other_band")) <= 1) & ((F.col("cell") != F.col("other_cell")) | (F.col("cell") == -1))
    met = materialise(cells.join(near, "path").where(apart), "cell-pairs", few=True)

    rows = rows.join(met, ["path", "band", "cell"]).withColumn("tile", F.pmod(F.xxhash64("rep", "path"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other_tile", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    this, that = F.struct("band", "cell", "tile"), F.struct(*[F.col(f"other_{c}").alias(c) for c in ("band", "cell", "tile")])
    side = F.when(this == that, 2).when(this < that, 0).otherwise(1).alias("side")
    rows = rows.select("rep", F.xxhash64("path", F.least(this, that), F.greatest(this, that)).alias("pair"), side)
    rows = rows.join(reps.select("rep", "bits"), "rep").repartition("pair").sortWithinPartitions("pair", "side")
    least = math.ceil(loose * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["pair"]):
            side = group.column("side").to_numpy()
            if group.num_rows < 2 or (side[0] == side[-1] and side[0] != 2):
                continue  # the other tile is empty
            label = similar_sketches(_bits(group), least, None if side[0] == side[-1] else side)
            yield from _links(group.column("rep").to_numpy(), label)

    return rows.mapInArrow(run, "a long, b long").distinct()


def candidate_classes(reps: DataFrame, roots: list[tuple[int, int]], bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """node, root of all sets that are similar by sketch to another in a bucket of the chosen paths."""
    rows, small, links = root_paths(reps, roots), [], []
    for level in range(1, depth + 1):
        sizes = materialise(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes", few=True)
        sized = materialise(rows.join(sizes, "path"), "buckets", few=True)
        small.append(sized.where(F.col("size") <= bucket).select("path", "rep"))
        large = sized.where(F.col("size") > bucket)
        if large.isEmpty():
            break
        # From here to the next level the sets carry their sketches.
        met = materialise(hub_classes(large.join(reps.select("rep", "bits"), "rep"), bucket), "hub-classes", few=True)
        links.append(met.where("near <> rep").select(F.col("rep").alias("a"), F.col("near").alias("b")).distinct())
        counts = met.where("class is not null").groupBy("path", "class").agg(F.count("*").alias("k"))
        most = counts.groupBy("path").agg(F.max(F.struct("k", "class")).alias("most")).select("path", "most.k", F.col("most.class").alias("widest"))
        # A hub is empty, by its sets' hashes, in few buckets or none: these have no class.
        met = met.join(materialise(most, "widest-classes", few=True), "path", "left")
        met = met.withColumn("rest", F.col("size") - F.coalesce("k", F.lit(0))).withColumn("main", F.coalesce(F.col("class") == F.col("widest"), F.lit(False)))
        met = materialise(met.where("rest > 0").drop("k", "widest", "near"), "large-buckets", few=True)
        links.append(rest_links(met.where(F.col("rest") <= bucket), bucket))
        open_ = met.where(F.col("rest") > bucket)
        if open_.isEmpty():
            break
        if level == depth:
            links.append(whole_links(open_, reps, bucket))
        else:
            rows = child_paths(open_)
    ends = small[0]
    for more in small[1:]:
        ends = ends.unionByName(more)
    found = bucket_links(ends, reps)
    for more in links:
        found = found.unionByName(more)
    return components(found)


# Exact comparison inside candidate classes


def linked_sets(sizes: np.ndarray, apart: list[np.ndarray], least: float, split: int | None = None) -> np.ndarray:
    """Whether each pair of sets has similarity ``least``; with ``split``, of pairs across that place only.

    ``sizes`` are the sets' own, ``apart`` their symmetric differences to one and the same set, which may be the empty
    one. The symmetric difference of two sets is that of those, so no more is needed.
    """
    n = len(apart)
    lengths = np.array([len(s) for s in apart])
    values, at, counts = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), lengths)
    shared = counts[at] > 1
    row, at = row[shared], (np.cumsum(counts > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for start in range(0, int((counts > 1).sum()), width):
        a, b = np.searchsorted(at, (start, start + width))
        part = np.zeros((n, min(width, int(at[b - 1]) - start + 1)), np.float32)
        part[row[a:b], at[a:b] - start] = 1
        common += part @ part.T
    # With d of the difference: the union has (sizes + d) / 2, the intersection (sizes - d) / 2 elements.
    total = (sizes[:, None] + sizes[None, :]).astype(np.float64)
    differ = lengths[:, None] + lengths[None, :] - 2.0 * common
    linked = total - differ >= least * (total + differ) - 1e-3
    np.fill_diagonal(linked, False)
    if split is not None:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    label = np.full(len(linked), -1)
    for first in range(len(linked)):
        if label[first] < 0:
            todo = np.array([first])
            while len(todo):
                label[todo] = first
                todo = np.flatnonzero(linked[todo].any(axis=0) & (label < 0))
    return label


def exact_links(classes: DataFrame, docs: DataFrame, text: str, doc_id: str, least: float, tile: int = TILE) -> DataFrame:
    """rep, root (a rep it reaches by links), texts and copies it links to; a row of each for every group that has it.

    ``classes`` has class (one of its reps), rep, copies, rep_doc, text_key, n of the sets to compare.
    """
    sizes = classes.groupBy("class").agg(F.count("*").alias("size"), F.sum("n").alias("all"))
    # Tiles are bounded by their sets and by their shingles; a class of one tile is compared there as it is.
    tiles = F.ceil(F.greatest(F.col("size") / tile, F.col("all") / TILE_SHINGLES)).cast("int")
    sizes = materialise(sizes.select("class", tiles.alias("tiles")), "class-sizes", few=True)
    wanted = classes.join(sizes, "class").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    rows = docs.select(docs[doc_id].alias("doc_id"), normalised(docs[text]).alias("t")).withColumn("key", F.md5("t"))
    # The wanted texts are a share of all: hashed by partition at every size, which spares sorting the texts.
    met = rows.join(wanted.hint("shuffle_hash"), (rows["key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(wanted["rep_doc"]))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [s.tobytes() for s in shingle_sets(texts(batch.column("t")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    names = ["class", "rep", "copies", "tiles", "tile"]
    found = met.select(*names, "t").mapInArrow(shingled, "class long, rep long, copies long, tiles int, tile int, shingles binary")
    found = materialise(found, "sets")
    keys = ["class", "low", "high"]
    whole = [(F.length("shingles") / 8).cast("int").alias("n"), F.col("shingles").alias("apart")]
    grouped = found.where("tiles = 1").select("class", F.lit(0).alias("low"), F.lit(0).alias("high"), "tile", "rep", "copies", *whole)
    if not sizes.where("tiles > 1").isEmpty():
        # One set of each large class goes to its tiles, where the others become their differences to it.
        base = found.where("tiles > 1 and rep = class").dropDuplicates(["class"])
        base = base.select("class", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("shingles").alias("base"))
        large = found.where("tiles > 1").join(base, ["class", "tile"], "left")

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                sets, n = [], []
                for x, y in zip(batch.column("shingles").to_pylist(), batch.column("base").to_pylist(), strict=True):
                    own = np.frombuffer(x, np.uint64)
                    n.append(len(own))
                    sets.append(np.setxor1d(own, np.frombuffer(y or b"", np.uint64), assume_unique=True).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int32()), pa.array(sets, pa.binary())], [*names, "n", "apart"])

        # Tile pairs (i, j), i <= j: a set goes to the pairs that have its tile.
        large = large.mapInArrow(apart, "class long, rep long, copies long, tiles int, tile int, n int, apart binary")
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        large = large.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
        grouped = grouped.unionByName(large.select(*keys, "tile", "rep", "copies", "n", "apart"))
    grouped = grouped.repartition(*keys).sortWithinPartitions(*keys, "tile", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            rep = group.column("rep").to_numpy()
            _, first = np.unique(rep, return_index=True)  # rows that repeat an id and a text come twice
            group = group.take(pa.array(np.sort(first)))
            if group.num_rows < 2:
                continue
            rep, copies, tiles, n = (group.column(c).to_numpy() for c in ("rep", "copies", "tile", "n"))
            apart = [np.frombuffer(x, np.uint64) for x in group.column("apart").to_pylist()]
            across = int(np.searchsorted(tiles, tiles[0], "right")) if tiles[0] != tiles[-1] else None
            if group.column("low")[0].as_py() != group.column("high")[0].as_py() and across is None:
                continue  # the other tile is empty
            linked = linked_sets(n, apart, least, across)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                root = rep[_roots(linked)]
                degrees = [linked.sum(axis=1)[some].astype(np.int64), (linked @ copies)[some].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[some], root[some], *degrees)], ["rep", "root", "texts", "docs"])

    return grouped.mapInArrow(compared, "rep long, root long, texts long, docs long")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least: float = LEAST,
    recall: float = RECALL,
    bucket: int = BUCKET,
    depth: int = DEPTH,
    tile: int = TILE,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, n_links, n_texts.

    class_id is the smallest id that links lead to, n_links the number of other rows that the row links to, copies
    included, n_texts the number of different texts among those.
    """
    roots = root_positions(runs_for(recall, depth), np.random.default_rng(seed))
    own = materialise(sketched(docs, text, doc_id, roots, seed), "sketches")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id")
    same = [F.first(c).alias(c) for c in ("n", "firsts", "bits")]  # equal texts have equal sketches
    reps = own.groupBy("text_key").agg(F.min(order).alias("first"), F.count("*").alias("copies"), *same)
    reps = reps.select(F.monotonically_increasing_id().alias("rep"), "text_key", F.col("first.doc_id").alias("rep_doc"), "copies", "n", "firsts", "bits")
    reps = materialise(reps, "texts", few=True)
    sets = reps.where("n > 0")

    candidates = candidate_classes(sets, roots, bucket, depth)
    classes = candidates.join(reps.select("rep", "text_key", "rep_doc", "copies", "n"), F.col("node") == F.col("rep")).withColumnRenamed("root", "class")
    found = materialise(exact_links(classes.drop("node"), docs, text, doc_id, least, tile), "links", few=True)
    degrees = found.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots_ = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))

    named = reps.select("rep", "text_key", "rep_doc", "copies", "n").join(degrees, "rep", "left").join(roots_.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialise(named.withColumn("root", F.coalesce("root", "rep")), "named-texts", few=True)
    first = F.min(F.struct(F.isnull("rep_doc").alias("no_id"), "rep_doc")).alias("first")
    heads = named.where("texts > 0").groupBy("root").agg(first).select("root", F.col("first.rep_doc").alias("head"))
    named = named.join(heads, "root", "left")
    empty = F.col("n") == 0
    texts_ = F.coalesce("texts", F.lit(0)) + F.when(F.col("copies") > 1, 1).otherwise(0)
    named = materialise(
        named.select(
            "text_key",
            F.when(~empty, F.when(F.col("texts") > 0, F.col("head")).otherwise(F.col("rep_doc"))).alias("class_id"),
            empty.alias("empty"),
            F.when(empty, 0).otherwise(F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.when(empty, 0).otherwise(texts_).cast("long").alias("n_texts"),
        ),
        "text-classes",
        few=True,
    )
    class_id = F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return own.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", class_id, "n_links", "n_texts")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the row of the smallest id of each class; rows that share its id and its text stay with it."""
    found = near_duplicates(docs, text, doc_id)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = materialise(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "near-copies", few=True)
    copy = F.col(doc_id).eqNullSafe(F.col("__gone_id")) & (F.md5(normalised(F.col(text))) == F.col("__gone_key"))
    return docs.join(gone.hint("shuffle_hash"), copy, "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts")


#: All pairs that share a shingle, and what they reach: for small tables.
ORACLE = r"""
with recursive d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), k as materialized (
  select t, min(doc_id) as first, count(*)::bigint as copies, regexp_extract_all(t, '[^\x20]+') as w from d group by t
), s as materialized (
  select distinct t, array_to_string(w[i : i + 4], ' ') as shingle
  from (select t, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from k where len(w) > 0)
), n as materialized (select t, count(*)::bigint as n from s group by t
), c as (select a.t as x, b.t as y, count(*)::bigint as c from s a join s b using (shingle) where a.t <> b.t group by all
), l as materialized (
  select x, y from c join n p on p.t = x join n q on q.t = y where 10 * c >= 8 * (p.n + q.n - c)
), r as (
  select t, first from k union select y, r.first from r join l on x = r.t
), g as (
  select t, min(first) as class_id from r group by t
), e as (
  select x as t, sum(copies)::bigint as docs, count(*)::bigint as texts from l join k on k.t = y group by x
)
select doc_id, case when n is null then doc_id else class_id end as class_id,
       case when n is null then 0 else copies - 1 + coalesce(docs, 0) end::bigint as n_links,
       case when n is null then 0 else (copies > 1)::int + coalesce(texts, 0) end::bigint as n_texts
from d join k using (t) join g using (t) left join n using (t) left join e using (t)
"""
