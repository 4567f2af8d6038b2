import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexigraph.llm import exact_dedup as E


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    return groups


def weak(column):
    return F.pmod(F.xxhash64(column), F.lit(3)).cast("long")


def cases():
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta,", "gamma.", "Delta", "e"]) for _ in range(6000))
    rows = [(None, ""), (1, ""), (2, None), (3, " \t\n"), (4, "a b"), (5, "a\x0b\x0cb"), (6, "a b"), (7, long), (8, long.replace(" ", "\n")), (9, long + "."), (10, "x" * 9000), (11, "x" * 9000)]
    for k in range(60):
        rows.append((100 + k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))))
    return rows


def test_chunks_make_up_their_text(spark):
    texts = [normal(t) for _, t in cases()]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.chunks(F.col("t")).alias("c"))
    for r in frame.collect():
        assert "".join(r.c) == r.t and all(1 <= len(x) <= 4096 for x in r.c)


def test_an_insertion_leaves_distant_chunks(spark):
    text = normal(cases()[7][1])
    frame = spark.createDataFrame([("Some new words. " + text,), (text,)], "t string").select(E.chunks(F.col("t")).alias("c"))
    a, b = (set(r.c) for r in frame.collect())
    assert len(a & b) > 0.7 * len(b)


@pytest.mark.parametrize("fingerprint", [F.xxhash64, weak])
def test_against_brute_force(spark, fingerprint):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, recipe string").repartition(4)
    got = {(r.doc_id): r for r in E.exact_duplicates(docs, fingerprint=fingerprint).collect()}
    groups = brute(rows)
    for i, t in rows:
        own = groups[normal(t)]
        r = got[i]
        assert r.keep_id == min(x for x in own if x is not None) and r.group_size == len(own), (i, own, r)
        assert r.kept == (i == r.keep_id) and r.text_sha256 == hashlib.sha256(normal(t).encode()).hexdigest()


def test_deduplicated_keeps_one_row_of_each_text(spark):
    rows = [*cases(), (4, "a b"), (4, "a  b"), (4, "other"), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(4)
    kept = E.deduplicated(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    groups = brute(rows)
    assert sorted(normal(r.text) for r in found) == sorted(groups)
    for r in found:
        ids = [x for x in groups[normal(r.text)] if x is not None]
        assert r.doc_id == (min(ids) if ids else None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_duplicates(docs).count() == 0 and E.deduplicated(docs).count() == 0
