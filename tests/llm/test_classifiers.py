import random
import zlib

import numpy as np
import pytest

from lexigraph.llm import labelled, quality, term_hashes, toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
INSULTS, GROUPS = ["fool", "clod", "oaf"], ["northerners", "southerners", "easterners"]


def sentences(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def junk(rng, n):
    return " ".join(w.upper() + "!!" if rng.random() < 0.5 else f"{w}%%%" for w in rng.choices(WORDS, k=n))


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t, _ in rows], "doc_id long, text string, source string, score double").repartition(4)
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(scored, rows, least):
    got = {r.doc_id: r.score for r in scored.collect()}
    assert len(got) == len(rows)
    out = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    return np.mean([(got[i] >= least) == y for i, y in out])


def test_quality_on_held_out_documents(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, 40) if i % 4 else junk(rng, 40), int(i % 4 > 0)) for i in range(600)]
    docs, labels = frames(spark, rows)
    model = quality.train(docs, labels)
    assert accuracy(quality.score(docs, model), rows, 0.5) > 0.97
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - 450) < 15


def test_pairs_make_toxicity(spark):
    """An insult and a group's name are toxic together only: weights that add up cannot tell that."""
    rng, rows = random.Random(2), []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(WORDS, k=12) + [rng.choice(INSULTS)] * insult + [rng.choice(GROUPS)] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    docs, labels = frames(spark, rows)
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score(docs, model), rows, 0.5) > 0.97
    assert len(model.weights) < 40 and model.factors.shape[1] == 4


def test_pairs_without_marginal_effect_make_toxicity():
    """Toxic are texts with both words or with neither: each word alone is as frequent in both classes."""
    rng, rows = random.Random(5), []
    for _ in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(WORDS, k=8) + ["oaf"] * a + ["northerners"] * b
        rng.shuffle(words)
        rows.append((" ".join(words), int(a == b)))
    model = toxicity.fit([t for t, _ in rows[:1600]], [y for _, y in rows[:1600]], {0: 800, 1: 800})
    found = model.scores([t for t, _ in rows[1600:]]) >= 0.5
    assert np.mean(found == [y for _, y in rows[1600:]]) > 0.97


def test_rare_insults_are_learned():
    """Each of 40 insults is in three toxic texts of the sample."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}ow" for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    insults = [f"zq{i}x{i}" for i in range(40)]
    rows = [" ".join(rng.choices(words, k=30) + ([insults[i // 10 % 40]] if i % 10 == 0 else [])) for i in range(1200)]
    model = toxicity.fit(rows, [int(i % 10 == 0) for i in range(1200)], {0: 1080, 1: 120})
    assert np.mean(model.scores([" ".join(rng.choices(words, k=30) + [x]) for x in insults]) >= 0.7) > 0.6
    assert np.mean(model.scores([" ".join(rng.choices(words, k=30)) for _ in range(400)]) >= 0.7) < 0.02


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    rng = random.Random(3)
    rows = [(i, sentences(rng, 10) if i % 2 else junk(rng, 10) + " oaf", i % 2) for i in range(60)]
    docs, labels = frames(spark, rows)
    model = module.train(docs, labels.unionByName(labels))  # repeated labels
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, " \n"), (3, "x" * 200_000), (4, "é " * 90_000), (5, "a\x00b")], "doc_id long, text string")
    got = module.score(odd, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.score(odd.limit(0), model).count() == 0
    nothing = module.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in module.score(odd, nothing).collect()} == {0.5}
    one = module.train(docs, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in module.score(odd, one).collect())


def test_labels_of_held_out_ids_and_null_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (500, 1), (3, None)], "doc_id long, quality int")
    texts, found, counts = labelled.training_rows(docs, labels, "quality", 20, 1)
    ids = [int(t.split()[1]) for t in texts]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) and [i % 2 for i in ids] == found
    assert found.count(0) == 20 and sum(counts.values()) >= 60
    assert labelled.training_rows(docs.repartition(3), labels, "quality", 20, 1)[0] == texts


def test_scores_do_not_depend_on_neighbours():
    rng = random.Random(4)
    rows = [sentences(rng, rng.randrange(0, 80)) for _ in range(200)] + ["", "a", "a"]
    model = quality.fit(rows, [len(r) % 2 for r in rows], {0: 100, 1: 103}, steps=200)
    assert np.array_equal(model.scores(rows), [model.scores([r])[0] for r in rows])


def test_hashes_of_words_and_ngrams():
    block = term_hashes.Bytes([b"ab abc ab", b"", b"abc"])
    starts, ends = block.words(~term_hashes.SPACES)
    h = term_hashes.word_hashes(block.data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and block.of(starts).tolist() == [0, 0, 0, 2]
    assert term_hashes.word_hashes(block.data, starts, ends, 2)[1] == h[0]
    texts = ["ab ábc ab", "", "日本語 é", "abc"]
    block = term_hashes.Bytes([t.encode() for t in texts])
    points, begins = block.characters()
    joined = " " + " ".join(texts) + " "
    assert [chr(p) for p in points] == list(joined) and [joined[a : b - 1] for a, b in zip(begins[:-1] + 1, begins[1:] + 1, strict=True)] == texts
    for (grams, places), n in zip(term_hashes.ngram_hashes(points, (3, 4)), (3, 4), strict=True):
        shown = [joined[p : p + n] for p in places]
        assert shown == [joined[p : p + n] for p in range(len(joined) - n + 1) if " " not in joined[p + 1 : p + n - 1]]
        assert len({*zip(grams.tolist(), shown, strict=True)}) == len(set(shown)) == len(set(grams.tolist()))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_against_brute_force(module):
    """The vectorised scores of a block are those of the formulas, reckoned feature by feature."""
    rng = random.Random(7)
    rows = [sentences(rng, rng.randrange(1, 30)) + (" oaf" if i % 2 else "") for i in range(80)] + ["été été 日本語 x", "a", ""]
    model = module.fit(rows, [i % 2 for i in range(len(rows))], {0: 41, 1: 42})
    for row, score in zip(rows, model.scores(rows), strict=True):
        if module is quality:
            total, n = 0.0, 0
            for buckets, _ in quality.features(term_hashes.Bytes([row.encode()])):
                for b in buckets.tolist():
                    total, n = total + float(model.weights[b]), n + 1
            odds = model.bias + total / max(n, 1)
        else:
            found = sorted(set(toxicity.terms(term_hashes.Bytes([row.lower().encode()]))[0].tolist()))
            known = {b: k for k, b in enumerate(model.buckets.tolist())}
            own = [known[b] for b in found if b in known]
            odds = model.bias + sum(float(model.weights[k]) for k in own)
            share = min(1.0, toxicity.SHORT / max(1, len(found)))
            for x, k in enumerate(own):
                odds += share * sum(float(model.factors[k].astype(float) @ model.factors[j]) for j in own[:x])
        assert abs(score - 1 / (1 + np.exp(-odds))) < 1e-5


def test_training_is_bounded_and_counts_documents_only(spark):
    rows = [(i, f"text {i}" * 10) for i in range(60)] + [(5, "a smaller text"), (5, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    texts, found, counts = labelled.training_rows(docs, labels, "quality", 100, 1)
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert counts == {c: sum(i % 2 == c for i in usable) for c in (0, 1)}
    assert len(texts) == len(usable) and ("a smaller text" in texts) == (5 in usable) and "zzz" not in texts
    fewer = labelled.training_rows(docs, labels, "quality", 100, 1, chars=500)[0]
    assert sum(map(len, fewer)) <= 500 and set(fewer) < set(texts)
