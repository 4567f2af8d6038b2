"""Secret scans in DataFrame operations only: fixed patterns, and Markov models of characters for the rest.

Two first-order Markov chains over the characters of keys are trained from labelled samples: one on random strings
(generated ones, and the values that the fixed patterns find), one on ordinary identifiers (all other tokens). A run of
key characters whose log-likelihood ratio per transition favours the random chain is a secret too; if the whole run
doesn't, as in a path or URL, its parts between separators are scored alone. The fixed patterns' matches are blanked
first, one kind after the other, so what lies beside them is a run of its own. A short run needs the same sum as one of
FULL characters. Both chains are counted in Spark; what reaches the driver has at most twice the square of the
alphabet's rows.

Null and empty texts have no spans, repeated rows have equal ones, an empty table gives an empty result. Positions are
code points, ends exclusive. A very long text is scanned whole, in time that grows with its length and its matches.
Without any labelled random string the random chain is uniform, which is what random strings look like. Columns other
than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.scratch import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KEY = "[A-Za-z0-9+/_.=-]"
#: Candidates are whole runs of key characters, and parts of them, from this length on; length from which the mean counts.
LONG, PART, FULL = rf"(?<!{KEY}){KEY}{{12,}}", r"[A-Za-z0-9+]{12,}", 20
KINDS = ("assign", "access", "hex", "markov")
SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Expected number of documents whose ordinary tokens are trained on; the sample is drawn by a hash of the id.
TRAINING_DOCS = 2000
#: Random strings that the chain is trained on, at most, from all documents, and generated ones besides.
TRAINING_STRINGS, GENERATED = 5000, 500
#: Matches that are summed up at once.
STEP = 256
#: Least log-likelihood ratio, in nats per transition, of a secret, and least number of different characters.
MARGIN, DISTINCT = 0.6, 8


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` reckoned once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _before(lengths: Column) -> Column:
    """For each length of an array the sum of those before it.

    A fold that appends copies its array at each step, so it runs over STEP lengths at a time, after one over their sums.
    """
    none = F.array().cast("array<int>")

    def sums(values: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), none.alias("out")), step, lambda s: s["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda k: F.slice(lengths, k * STEP + 1, F.lit(STEP)))
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x)
    return _let(chunks, lambda c: F.flatten(F.zip_with(c, sums(F.transform(c, total), F.lit(0)), sums)))


PIECES = "array<struct<gap:string,match:string,value:string>>"


def _pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of ``pattern`` with the text before each and the value of ``group``; last the rest, with no match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group)]
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found[0].alias("match"), found[1].alias("value")).cast(PIECES)


def _located(pieces: Column) -> Column:
    """start, end, match and value of each match."""

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))

        def span(x: Column, before: Column) -> Column:
            start = before + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"), x["value"].alias("value"))

        return F.filter(F.zip_with(p, _before(lengths), span), lambda x: x["match"].isNotNull())

    return _let(pieces, spans)


def _blanked(pieces: Column, which: Callable[[Column], Column]) -> Column:
    """The text of the pieces, with spaces for those matches that ``which`` says."""
    shown = lambda x: F.when(which(x), F.repeat(F.lit(" "), F.length(x["match"]))).otherwise(x["match"])
    return F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(shown(x), F.lit("")))), "")


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def with_base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (t, not null) with assign, access, hex (spans of each fixed pattern) and rest (the text without them).

    Every kind's spans are those in the whole text. Each step's columns are used several times in the next, which
    Catalyst then doesn't fold into one.
    """
    none = F.array().cast(PIECES)
    passes = lambda x: F.length(x["value"]) >= 12
    any_ = lambda column, pattern: F.col(column).rlike(pattern)
    rows = rows.withColumn("a", F.when(any_("t", ASSIGN), _pieces(F.col("t"), ASSIGN, 2)).otherwise(none))
    rows = rows.withColumn("rest", F.when(F.size("a") > 0, _blanked(F.col("a"), passes)).otherwise(F.col("t")))
    rows = rows.withColumn("assign", F.when(F.size("a") > 0, _spans(F.filter(_located(F.col("a")), passes), 0)).otherwise(F.array().cast(SPAN)))
    # A run that starts too late for its length has no longer match either: the length can stand in the pattern.
    kinds = (("access", ACCESS, 1, F.col("t").contains("AKIA")), ("hex", HEX, 2, any_("t", HEX)))
    for kind, pattern, number, found in kinds:
        spans = F.when(found & any_("t", pattern), _spans(_located(_pieces(F.col("t"), pattern)), number)).otherwise(F.array().cast(SPAN))
        rows = rows.withColumn(kind, spans)
        blanked = _blanked(_pieces(F.col("rest"), pattern), lambda x: F.lit(True))
        rows = rows.withColumn("rest", F.when(F.size(kind) > 0, blanked).otherwise(F.col("rest")))
    return rows.drop("a")


def labelled_samples(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    training_docs: int = TRAINING_DOCS,
    training_strings: int = TRAINING_STRINGS,
    generated: int = GENERATED,
) -> DataFrame:
    """token, random (boolean): random strings, and other tokens, and identifiers made of them, of a hash sample of documents.

    Random are ``generated`` strings of 43 characters made by hashes, and of the values that the fixed patterns find in
    all documents those ``training_strings`` with the smallest hashes. The sample has about ``training_docs`` documents,
    or all.
    """
    n = docs.count()
    share = min(1.0, training_docs / max(n, 1))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = lambda pattern, group: F.when(F.col("t").rlike(pattern), F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    values = F.filter(F.concat(found(ASSIGN, 2), found(ACCESS, 0), found(HEX, 0)), lambda v: F.length(v) >= 12)
    strings = rows.select("id", F.explode(values).alias("token")).orderBy(F.md5(F.concat_ws(":", "id", "token")), "token").limit(training_strings)
    made = docs.sparkSession.range(generated).select(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("key:"), "id"), 256))), "=", "").alias("token"))
    others = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    chosen = rows.where(F.conv(F.substring(F.md5("id"), 1, 5), 16, 10).cast("int") < int(share * (1 << 20)))
    chosen = chosen.select(others.alias("t"))
    # Prose has few identifiers, so every three words of it make one: with a separator, with capitals, or all in capitals.
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0))
    separator = lambda i: F.get(F.array(*[F.lit(c) for c in ("_", "-", "/", ".", "=", "", "", "_")]), i % 8)
    cased = lambda w, i: F.when(i % 8 == 7, F.upper(w)).when(i % 8 >= 5, F.initcap(w)).otherwise(w)
    word = lambda x, i, k: cased(F.get(x, F.lit(k)), i)
    joined = lambda x, i: F.concat(word(x, i, 0), separator(i), word(x, i, 1), separator(i), word(x, i, 2))
    places = lambda w: F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.floor(F.size(w) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    made_of = _let(words, lambda w: F.transform(places(w), lambda i: joined(F.slice(w, i * 3 + 1, F.lit(3)), i)))
    tokens = chosen.select(F.explode(F.concat(F.regexp_extract_all("t", F.lit(KEY + "{4,}"), F.lit(0)), made_of)).alias("token"))
    random = strings.select("token").unionByName(made).select("token", F.lit(True).alias("random"))
    return random.unionByName(tokens.select("token", F.lit(False).alias("random")))


def ratios(samples: DataFrame, backoff: float = 10.0) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for each pair of ALPHABET, row by row, from (token, random).

    P(b | a) is estimated from the pair's count and ``backoff`` times the share of b at all, so that transitions which
    a sample of random strings happens not to show aren't taken as rare.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("token") - 1))
    pairs = samples.where(F.length("token") > 1).select("random", "token", at.alias("at"))
    pairs = pairs.select("random", F.col("token").substr(F.col("at"), F.lit(2)).alias("pair"))
    counts = {(row["random"], row["pair"]): row["count"] for row in pairs.groupBy("random", "pair").count().collect()}
    logs = {}
    for random in (True, False):
        n = {(a, b): counts.get((random, a + b), 0) for a in ALPHABET for b in ALPHABET}
        total = sum(n.values())
        share = {b: (sum(n[a, b] for a in ALPHABET) + 1) / (total + len(ALPHABET)) for b in ALPHABET}
        for a in ALPHABET:
            seen = sum(n[a, b] for b in ALPHABET)
            logs |= {(random, a, b): math.log((n[a, b] + backoff * share[b]) / (seen + backoff)) for b in ALPHABET}
    return [logs[True, a, b] - logs[False, a, b] for a in ALPHABET for b in ALPHABET]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions; characters outside ALPHABET count as none."""
    # One string literal, folded into an array once: thousands of literals would be as many nodes of the plan.
    weights = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pair = lambda i: place(token.substr(i, F.lit(1))) * len(ALPHABET) + place(token.substr(i + 1, F.lit(1)))
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.coalesce(F.get(weights, pair(i)), F.lit(0.0))) / (F.length(token) - 1)


def scan(docs: DataFrame, model: list[float], text: str = "text", doc_id: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """doc_id, base (spans of the fixed patterns), spans (all: start, kind, end in order of start, then KINDS), n_<kind>."""
    rows = with_base_spans(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    # A candidate must be random by its letters and not merely repeat few characters.
    least = lambda x: F.lit(margin) * F.greatest(F.lit(1.0), F.lit(FULL - 1.0) / (F.length(x["match"]) - 1))
    odd = lambda x: (F.size(F.array_distinct(F.split(x["match"], ""))) >= DISTINCT) & (log_ratio(x["match"], model) > least(x))
    moved = lambda x, by: F.struct((x["start"] + by).alias("start"), F.lit(3).alias("kind"), (x["end"] + by).alias("end"))
    parts = lambda x: F.transform(F.filter(_located(_pieces(x["match"], PART)), odd), lambda y: moved(y, x["start"]))
    secrets = lambda x: F.when(odd(x), F.array(moved(x, F.lit(0)))).when(x["match"].rlike("[/._=-]"), parts(x)).otherwise(F.array().cast(SPAN))
    found = F.flatten(F.transform(_located(_pieces(F.col("rest"), LONG)), secrets))
    rows = rows.withColumn("markov", F.when(F.col("rest").rlike(LONG), found).otherwise(F.array().cast(SPAN)))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", base.alias("base"), "markov", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS])
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "markov")).alias("spans"), *[f"n_{kind}" for kind in KINDS])


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, ratios(labelled_samples(docs)))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"), "n_markov"
    )


def oracle() -> str:
    """The samples, the chains, the fixed patterns and the scores in DuckDB's SQL, in this module's constants."""
    key = KEY[1:-1]
    places = lambda name, source, pattern, kind, group: f"""
{name}_m as (
  select doc_id, {source} as s, unnest(regexp_extract_all({source}, {pattern})) as m, unnest(regexp_extract_all({source}, {pattern}, {group})) as v,
         unnest(regexp_split_to_array({source}, {pattern})[:-2]) as gap, generate_subscripts(regexp_extract_all({source}, {pattern}), 1) as pos
  from {name}_t where regexp_matches({source}, {pattern})
), {name} as (
  select doc_id, {kind} as kind, m, v, (sum(length(gap) + length(m)) over w)::bigint - length(m) as a, (sum(length(gap) + length(m)) over w)::bigint as b
  from {name}_m window w as (partition by doc_id order by pos)
)"""  # noqa: E731
    blanked = lambda name, source, which: f"""
{name}_b as (
  select doc_id, string_agg(gap || case when {which} then repeat(' ', length(m)) else m end, '' order by pos) as head, sum(length(gap) + length(m))::bigint as done
  from {name}_m group by doc_id
), {name}_r as (
  select t.doc_id, t.t, case when b.doc_id is null then {source} else head || substr({source}, done + 1) end as rest
  from {name}_t t left join {name}_b b using (doc_id)
)"""  # noqa: E731
    assign, access, hex_ = (f"$re${p}$re$" for p in (ASSIGN, ACCESS, HEX))
    pair = lambda c, i: f"instr('{ALPHABET}', substr({c}, {i}, 1))"
    score = lambda name, source: f"""
{name} as materialized (
  select c.doc_id, c.a, c.b, c.m, len(list_distinct(string_split(c.m, ''))) as letters,
         sum(coalesce(w.w, 0)) / (length(c.m) - 1) as mean
  from {source} c, unnest(range(1, length(c.m))) as u(i) left join model w on w.x = {pair('c.m', 'i')} and w.y = {pair('c.m', 'i + 1')}
  group by c.doc_id, c.a, c.b, c.m
)"""  # noqa: E731
    odd = f"letters >= {DISTINCT} and mean > {MARGIN} * greatest(1, {FULL - 1.0} / (length(m) - 1))"
    return f"""
with d as materialized (select doc_id, coalesce(text, '') as t from documents),
v as (
  select coalesce(doc_id::varchar, 'null') as id, unnest(list_concat(list_concat(regexp_extract_all(t, {assign}, 2), regexp_extract_all(t, {access})),
         regexp_extract_all(t, {hex_}))) as token from d
), strings as (select token from v where length(token) >= 12 order by md5(id || ':' || token), token limit {TRAINING_STRINGS}
), made as (select translate(to_base64(unhex(sha256('key:' || i))), '=', '') as token from range({GENERATED}) r(i)
), chosen as (
  select regexp_replace(regexp_replace(regexp_replace(t, {assign}, ' ', 'g'), {access}, ' ', 'g'), {hex_}, ' ', 'g') as t from d
  where ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 5))::int < floor(least(1.0, {TRAINING_DOCS}.0 / greatest((select count(*) from d), 1)) * 1048576)
), words as (select regexp_extract_all(t, '[A-Za-z]{{2,}}') as w from chosen
), threes as (
  select i % 8 as k, w[i * 3 + 1 : i * 3 + 3] as x from (select w, unnest(range(0, len(w) // 3)) as i from words)
), joined as (
  select case when k = 7 then upper(array_to_string(x, '_'))
              when k >= 5 then array_to_string([upper(y[1]) || lower(y[2:]) for y in x], '') else x[1] || sep || x[2] || sep || x[3] end as token
  from (select *, (['_', '-', '/', '.', '=', '', '', '_'])[k + 1] as sep from threes)
), samples as (
  select token, true as random from strings union all select token, true from made
  union all select token, false from joined union all select unnest(regexp_extract_all(t, '[{key}]{{4,}}')), false from chosen
), counted as (
  select random, substr(token, i, 2) as p, count(*) as n from (select random, token, unnest(range(1, length(token))) as i from samples) group by all
), letters as (select i as x, substr('{ALPHABET}', i, 1) as c from range(1, {len(ALPHABET) + 1}) r(i)
), grid as (
  select r.random, a.x, b.x as y, coalesce(n, 0) as n from (values (true), (false)) r(random), letters a, letters b
  left join counted q on q.random = r.random and q.p = a.c || b.c
), logs as (
  select random, x, y, ln((n + 10.0 * (sum(n) over (partition by random, y) + 1) / (sum(n) over (partition by random) + {len(ALPHABET)})) / (sum(n) over (partition by random, x) + 10.0)) as l
  from grid
), model as materialized (select x, y, round(sum(case when random then l else -l end), 4) as w from logs group by x, y
), assign_t as (select doc_id, t from d),{places('assign', 't', assign, 0, 2)},{blanked('assign', 't.t', 'length(v) >= 12')},
access_t as (select doc_id, t, rest from assign_r),{places('access', 't', access, 1, 0)},
access_rest_t as (select doc_id, t, rest from assign_r),{places('access_rest', 'rest', access, 1, 0)},{blanked('access_rest', 't.rest', 'true')},
hex_t as (select doc_id, t from d),{places('hex', 't', hex_, 2, 0)},
hex_rest_t as (select doc_id, t, rest from access_rest_r),{places('hex_rest', 'rest', hex_, 2, 0)},{blanked('hex_rest', 't.rest', 'true')},
run_t as (select doc_id, rest from hex_rest_r),{places('run', 'rest', "'[" + key + "]{12,}'", 3, 0)},{score('run_score', 'run')},
part_t as (select row_number() over () as doc_id, doc_id as id, a as start, m as t from run_score where not ({odd}) and regexp_matches(m, '[/._=-]')),
{places('part', 't', "'" + PART + "'", 3, 0).strip()},{score('part_score', 'part')},
base as (
  select doc_id, a, kind, b from assign where length(v) >= 12 union all select doc_id, a, kind, b from access union all select doc_id, a, kind, b from hex
), everything as (
  select * from base union all select doc_id, a, 3, b from run_score where {odd}
  union all select p.id, s.a + p.start, 3, s.b + p.start from part_score s join part_t p using (doc_id) where {odd}
), shown as (
  select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
         count(*) filter (where kind = 3) as n_markov,
         string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || a || ':' || b, ',' order by a, kind, b) filter (where kind < 3) as base,
         string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || a || ':' || b, ',' order by a, kind, b) as spans
  from everything group by doc_id
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_markov, 0)::bigint as n_markov
from d left join shown using (doc_id)
"""
