import re

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions.stemmer import stem_sql, stemmed
from lexigraph.operators import index
from lexigraph.sources import text as files

STEMS = {
    "university": "univers", "Universities": "Univers", "apple": "appl", "Apple": "Apple", "likes": "like", "Mouse": "Mous", "very": "veri",
    "possibly": "possibl", "geology": "geologi", "caresses": "caress", "ponies": "poni", "agreed": "agre", "matting": "mat", "mating": "mate",
    "milling": "mill", "relational": "relat", "computer": "comput", "computing": "comput", "one": "on", "aed": "a", "eed": "eed", "ion": "ion",
    "HAPPIES": "HAPPIES", "sky": "sky", "yyy": "yyi", "": "", "a": "a", "ss": "ss", "feed": "feed", "plastered": "plaster", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file",
    "happy": "happi", "conditional": "condit", "adoption": "adopt", "adjustment": "adjust", "controlling": "control", "rate": "rate", "cease": "ceas",
}


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "token string")
    assert {r.token: r.stem for r in stemmed(words).collect()} == STEMS


def test_stemmer_refuses_clashing_columns(spark):
    with pytest.raises(ValueError):
        stemmed(spark.createDataFrame([("a", 1)], "token string, w int"))


def test_tokens(spark):
    row = spark.createDataFrame([("The Cät 12a_b it's",), (None,), ("",)], "t string").select(T.tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in row] == [["The", "Cät", "12a", "b", "it", "s"], [], []]


def test_stop_words(spark, tmp_path):
    words = files.stop_words(spark)
    assert words.count() == 331
    terms = {r.term for r in index.stop_terms(words).collect()}
    assert len(terms) == 315 and "to" in terms and "elephant" not in terms
    (tmp_path / "stop").write_text("to\nthe\n\nthe\n")
    assert {r.word for r in files.stop_words(spark, str(tmp_path / "stop")).collect()} == {"to", "the"}


def test_dropped_and_kept_words(spark):
    words = "computing interesting sincerity systemic fired sides description universe partly numbers Above Only above".split()
    docs = spark.createDataFrame([(i, w, w) for i, w in enumerate(words)], "row_id long, title string, content string")
    kept = {r.title for r in index.term_counts(docs, files.stop_words(spark)).collect()}
    assert kept == {"description", "universe", "partly", "numbers", "Above", "Only"}


def test_stripping_pairs_and_rounding(spark):
    one = spark.createDataFrame([("John writes about this, and John Doe writes about that, and John Wayne writes about everything.",)], "t string")
    got = one.select(T.stripped(F.col("t"), "((John) (.+?)) ").alias("x")).first().x
    assert got == "about this, and writes about that, and writes about everything."
    pairs = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 1.5)], "f string, s double").select(T.pair(F.col("f"), F.col("s")).alias("p"))
    assert [r.x for r in pairs.orderBy("p").select(T.pair_text(F.col("p")).alias("x")).collect()] == ["a\t1.5", "a\t2.0", "b\t1.0"]
    assert spark.range(1).select(T.rounded(F.lit(0.123455)).alias("x"), F.lit(5e-4).cast("string").alias("y")).first() == (0.12346, "5.0E-4")


def test_counted_tokens(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "é"],), ([],), (["x"] * 5000,)], "w array<string>")
    found = [[(x.token, x.n) for x in r.c] for r in rows.select(T.counted(F.col("w")).alias("c")).collect()]
    assert found == [[("a", 1), ("b", 2), ("é", 1)], [], [("x", 5000)]]


def test_generated_methods_of_the_stemmer_are_short_enough_to_be_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes."""
    rows = spark.range(3).selectExpr("id as row_id", "cast(id as string) as title", "concat('happily', id) as token")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(stemmed(rows)._jdf.queryExecution().executedPlan()))
    assert sizes and max(map(int, sizes)) < 8000


def test_stems_of_odd_words(spark):
    """y's of all kinds, other scripts, signs: what a mask of patterns alone gives."""
    words = ["syzygy", "yayy", "sayys", "vyying", "don't", "étéed", "naïvely", "a\\bing", "Σyas", "toyed", "𝒜yies", "sky", "skies", "yyes", "ABILITIes"]
    rows = spark.createDataFrame([(w,) for w in words], "token string")
    db = pytest.importorskip("duckdb").connect()
    db.execute("create table words as select unnest(?) as token", [words])
    wanted = dict(db.sql(f"with {stem_sql('select token from words')} select * from stems").fetchall())
    assert {r.token: r.stem for r in stemmed(rows).collect()} == wanted
