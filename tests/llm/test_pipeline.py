"""The stages one after the other against brute force over a small table, and the whole run."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigraph.llm import mixing, quality
from lexigraph.llm.scratch import table

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def near_classes(rows):
    """The smallest id of each class of documents linked by shingle sets of similarity 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's documents and result."""
    out, docs = {}, table(spark, SF, "documents")
    for name, stage in P.STAGES:
        after = P.materialise(stage(spark, docs, SF), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == stages["quality classifier"][0].columns


def test_quality_keeps_what_scores_well(spark, stages):
    before, after = stages["quality classifier"]
    scored = quality.score(before, quality.train(before, table(spark, SF, "labels"))).where("score >= 0.5")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scored.collect())
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = [labels[r.doc_id] for r in after.collect() if r.doc_id in labels]
    assert sum(kept) == sum(labels.values()) and kept.count(0) <= 1


def test_dedup_stages_keep_the_first_of_each_class(stages):
    before, after = stages["exact dedup"]
    first = {}
    for r in sorted(before.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
    before, after = stages["n-gram Jaccard join"]
    assert {r.doc_id for r in after.collect()} == near_classes([(r.doc_id, r.text) for r in before.collect()])


def test_mix_and_tokens(stages):
    before, after = stages["mixing sources to target weights"]
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in plan.items() if n})
    before, after = stages["BPE encoding and decoding"]
    library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want = Counter()
    for r in before.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, after.collect())) == want


def test_run_equals_the_stages_and_itself(spark, stages):
    want = sorted(map(tuple, stages["BPE encoding and decoding"][1].collect()))
    assert sorted(map(tuple, P.run(spark, SF).collect())) == want


def test_stages_take_nulls_and_empty_tables(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a " * 50, None, "s", 100), (3, "a " * 50, "en", "s", 100)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, columns)
        for _, stage in P.STAGES:
            docs = P.materialise(stage(spark, docs, SF), "odd")
        assert docs.count() <= 2 * len(rows)


def test_stages_take_very_long_texts_and_clashing_columns(spark):
    docs = table(spark, SF, "documents").limit(60)
    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    more = spark.createDataFrame([(90_001, words, "en", "a", 1), (90_002, words + " end", "en", "a", 1)], docs.schema)
    docs = docs.unionByName(more)
    for name in ("rate", "copies", "rep", "t", "ids", "label", "score", "size"):
        docs = docs.withColumn(name, F.lit(7))
    columns = docs.columns
    for name, stage in P.STAGES[1:]:
        docs = P.materialise(stage(spark, docs, SF), "odd")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and {r.rate for r in docs.select("rate").distinct().collect()} == {7}
        if name == "n-gram Jaccard join":
            assert [r.doc_id for r in docs.where("doc_id > 90000").collect()] == [90_001]
    assert docs.count() > 0
