import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigraph.llm import bpe
from lexigraph.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    pool = list(" \n\t'stmrevlda1.٣é日 　🙂_-") + ["<|endoftext|>", "  ", "'ll", "word "]
    out = ["", None, "   ", "a<|endoftext|>b", "foo  <|endoftext|>  bar\n\n", "<|endoftext|>" * 2, "a\u0085b c d\x1ce\x1f", "x" * 5000, " " * 3000 + "a", "�\x00\x01", "a", "a"]
    out += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    # Letters that came into Unicode after version 13, and code points that are in none.
    later = [0x31350, 0x10570, 0x1E290, 0x11F04, 0x1DF00, 0x2EBF0, 0x1E4D0, 0x10EC2, 0x1C89, 0x1E030, 0x0378, 0xE0080]
    out += [form.format(chr(c)) for c in later for form in ("x{0}'s", "{0}", "a {0}{0}'ll\n {0}1 <|endoftext|>  b", "\n{0}\n\n word word", "{0}  ")]
    return out + ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x3000, 64)]


@pytest.mark.parametrize("table_words", [1 << 18, 40, 0])
def test_digests_equal_the_library(spark, library, table_words):
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(5)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, table_words=table_words).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i if i else None]
        assert r.n_tokens == len(ids), t
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), t
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t


def test_ids_and_texts_round_trip(spark, library):
    texts = [t or "" for t in odd_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "ids"]
    for r in bpe.decode(encoded, PATH).collect():
        assert r.decoded == r.text
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_results_replace_columns_of_their_names_and_others_stay(spark, library):
    rows = [(1, "x", 5, "a b c " * 60_000, "k"), (2, "y", None, None, None)]  # 360,000 characters
    docs = spark.createDataFrame(rows, "doc_id long, ids string, decoded int, text string, __word string")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "decoded", "text", "__word", "ids"]
    decoded = bpe.decode(encoded, PATH)
    assert decoded.columns == ["doc_id", "text", "__word", "decoded"]
    assert {(r.doc_id, r.decoded, r["__word"]) for r in decoded.collect()} == {(1, rows[0][3], "k"), (2, "", None)}


def test_the_table_has_the_words_of_most_rows(spark):
    lists = [["a", "b", "a"], ["a", "b"], ["a", "c"], ["d", "d", "d"], []]
    words = spark.createDataFrame([(x,) for x in lists], "__words array<string>")
    found = lambda *most: sorted(r.word for r in bpe.common_words(words, *most).collect())
    assert found() == ["a", "b"] and found(1) == ["a"] and found(0) == []
    assert bpe.common_words(words.limit(0)).count() == 0


def test_decoding_pieces_of_characters_and_nulls(spark, library):
    half = library.encode("🙂", add_special_tokens=False).ids[:1]
    rows = spark.createDataFrame([(1, half), (2, None), (3, []), (4, [50256])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: library.decode(half), 2: "", 3: "", 4: "<|endoftext|>"}


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 32), (100, 16)])
def test_spliced_counts_equal_whole_texts(library, chunk, overlap):
    counter, rng = Counter(bpe.read_vocabulary(PATH), chunk, overlap), random.Random(chunk)
    pool = [" ", "  ", "\n", "a", "the", "'s", "<|endoftext|>", "日本", "é", "1", "!!", "\xa0", " ", "word "]
    for k in range(800):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 200)))
        text = text.replace(" ", "") if k % 5 == 0 else text
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_spaceless_texts_are_spliced_in_linear_time(library):
    rng = random.Random(2)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for make in (lambda n: "".join(rng.choices(alnum, k=n)), lambda n: "".join(rng.choices("日本語文字列。、", k=n)), lambda n: "".join(rng.choices("abc", k=n))):
        counter, seconds = Counter(bpe.read_vocabulary(PATH), 4096, 64), []
        for n in (100_000, 400_000):
            text = make(n)
            began = time.time()
            found = counter.count(text)
            seconds.append(time.time() - began)
            assert found == len(library.encode(text, add_special_tokens=False).ids)
        assert seconds[1] < 12 * seconds[0] + 0.2, seconds


def test_text_without_any_boundary_is_one_piece(library):
    counter = Counter(bpe.read_vocabulary(PATH), 50, 10)
    assert counter.count("ab" * 500) == len(library.encode("ab" * 500).ids)
    assert counter.count(" " * 200_000 + "a") == len(library.encode(" " * 200_000 + "a").ids)


def test_token_counts_of_nulls_ties_and_long_texts(spark, library):
    rows = [(1, None), (2, ""), (3, "é word " * 30_000), (3, "é word " * 30_000), (None, "a"), (4, "x " * 512), (5, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    want = set()
    for i, t in rows:
        n = len(library.encode(t or "").ids)
        want.add((i, len((t or "").encode()), n, n > 512))
    assert got == want and token_counts(docs.limit(0), PATH).count() == 0
