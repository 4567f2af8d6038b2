"""Suffix stripping after Porter (Program 14(3), 1980) as SQL expressions.

Each step is one projection, so words are stemmed in generated code, without a UDF. The condition on a stem's measure
is a pattern over its mask, in which consonants are c and vowels v: no counting is needed. Only lower-case ASCII
letters are vowels; words of up to two characters stay as they are.

The steps are written once, as a list of (name, expression) in SQL that Spark and DuckDB both take but for the
functions in ``Dialect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes and what they become, in the order in which they are tried.
DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
# Fixed values, as above.
ENDED = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
# Suffixes that go, in the order in which they are tried.
DROPPED = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


@dataclass(frozen=True)
class Dialect:
    replace: str  # of all matches: text, pattern, replacement
    matches: str  # text, pattern
    letters: str = ""  # the mask of a word, but for y and what is not ASCII, where that is cheaper than by patterns
    first: str = ""  # the first of some suffixes that a word has: word, suffixes; one expression in place of one a suffix


#: The ASCII characters but y, by number where a literal would have to escape them, and what they are in a mask.
ASCII = [chr(k) for k in range(128) if chr(k) != "y"]
NAMED = "concat(" + ", ".join(f"'{c}'" if c.isalnum() else f"char({ord(c)})" for c in ASCII) + ")"
KINDS = "".join("v" if c in "aeiou" else "c" for c in ASCII)

SPARK = Dialect("regexp_replace({0}, '{1}', '{2}')", "{0} rlike '{1}'", f"translate({{0}}, {NAMED}, '{KINDS}')", "get(filter(array({1}), x -> endswith({0}, x)), 0)")
DUCKDB = Dialect("regexp_replace({0}, '{1}', '{2}', 'g')", "regexp_matches({0}, '{1}')")

CONSONANTS_OF_Y = [("^y", "c"), ("vy", "vc"), ("yy", "vc"), ("y", "v")]


def _replaced(word: str, pairs: list[tuple[str, str]], d: Dialect) -> str:
    for pattern, by in pairs:
        word = d.replace.format(word, pattern, by)
    return word


def _mask(word: str, d: Dialect) -> str:
    """The mask; with ``letters``, what ``_settled`` makes it of."""
    return d.letters.format(word) if d.letters else _replaced(word, [("[^aeiouy]", "c"), ("[aeiou]", "v"), *CONSONANTS_OF_Y], d)


def _settled(mask: str, d: Dialect) -> str:
    """The mask whose ASCII letters but y are done: few words have others, so that few need patterns."""
    rest = _replaced(mask, [("[^cvy]", "c"), *CONSONANTS_OF_Y], d)
    return f"case when {mask} like '%y%' or octet_length({mask}) <> length({mask}) then {rest} else {mask} end"


def _cut(word: str, suffix: str) -> str:
    return f"substr({word}, 1, length({word}) - {len(suffix)})"


def _first(word: str, pairs: list[tuple[str, str]], then) -> str:
    return "case " + " ".join(f"when {word} like '%{s}' then {then(s, r)}" for s, r in pairs) + " end"


def _based(pairs: list[tuple[str, str]], d: Dialect) -> list[list[tuple[str, str]]]:
    """``b``, the word without its suffix, null where it has none, and ``r``, the suffix."""
    suffixes = ", ".join(f"'{s}'" for s, _ in pairs)
    return [[("r", d.first.format("w", suffixes))], [("b", "case when r is not null then substr(w, 1, length(w) - length(r)) end")]]


def steps(d: Dialect) -> list[list[tuple[str, str]]]:
    """Projections one after the other; each adds or replaces columns, from ``w`` to ``w``. ``o`` is the word itself."""
    one = "(m like '%vc%' and not " + d.matches.format("m", "vc+v+c") + ")"
    more = d.matches.format("m", "vc+v+c")
    short = "(m like '%cvc' and {0} not like '%w' and {0} not like '%x' and {0} not like '%y')"
    plural = f"case when w like '%sses' then {_cut('w', 'es')} when w like '%ies' then {_cut('w', 'es')} when w like '%s' and w not like '%ss' then {_cut('w', 's')} else w end"

    def table(pairs: list[tuple[str, str]], condition: str) -> list[list[tuple[str, str]]]:
        if d.first:
            became = f"map({', '.join(f"'{s}', '{r}'" for s, r in pairs)})"
            change = f"case when o and b is not null and {condition} then concat(b, try_element_at({became}, r)) else w end"
            return [*_based(pairs, d), [("m", _mask("coalesce(b, '')", d))], [("w", change)]]
        return [
            [("b", _first("w", pairs, lambda s, r: _cut("w", s))), ("r", _first("w", pairs, lambda s, r: f"'{r}'"))],
            [("m", _mask("coalesce(b, '')", d))],
            [("w", f"case when o and b is not null and {condition} then concat(b, r) else w end")],
        ]

    past = [("eed", ""), ("ed", ""), ("ing", "")]
    dropped = [(s, "") for s in DROPPED]
    return [
        [("o", "length(w) > 2")],
        [("w", f"case when o then {plural} else w end")],
        # eed, ed, ing
        *(_based(past, d) if d.first else [[("b", _first("w", past, lambda s, r: _cut("w", s)))]]),
        [("m", _mask("coalesce(b, '')", d))],
        [
            ("w", f"case when o and w like '%eed' then case when m like '%vc%' then {_cut('w', 'd')} else w end when o and m like '%v%' then b else w end"),
            ("open", "coalesce(o and w not like '%eed' and b is not null and m like '%v%', false)"),
        ],
        [
            ("w", "case when open then case when w like '%at' or w like '%bl' or w like '%iz' then concat(w, 'e') "
                  "when m like '%c' and length(w) > 1 and substr(w, length(w), 1) = substr(w, length(w) - 1, 1) "
                  f"then case when w like '%l' or w like '%s' or w like '%z' then w else {_cut('w', 'x')} end "
                  f"when {one} and {short.format('w')} then concat(w, 'e') else w end else w end"),
        ],
        # y
        [("b", f"case when w like '%y' then {_cut('w', 'y')} end")],
        [("m", _mask("coalesce(b, '')", d))],
        [("w", "case when o and b is not null and m like '%v%' then concat(b, 'i') else w end")],
        *table(DERIVED, "m like '%vc%'"),
        *table(ENDED, "m like '%vc%'"),
        *table(dropped, f"{more} and (w not like '%ion' or b like '%s' or b like '%t')"),
        # e, then ll by the measure from before
        [("b", f"case when w like '%e' then {_cut('w', 'e')} end"), ("m", _mask("w", d))],
        [("two", more), ("once", one), ("m", _mask("coalesce(b, '')", d))],
        [("w", f"case when o and b is not null and (two or (once and not {short.format('b')})) then b else w end")],
        [("w", f"case when o and two and w like '%ll' then {_cut('w', 'l')} else w end")],
    ]


def stemmed(words: DataFrame, word: str = "token", stem: str = "stem") -> DataFrame:
    """``words`` with the column ``stem``; give it distinct words where they repeat much, as each costs some fifty expressions.

    Write the result before it is filtered or joined: Catalyst would carry conditions through the steps, each of which
    holds the one before several times. The search for a suffix is no generated code: it parts what is generated into
    methods that the JVM compiles, which it doesn't for those over 8,000 bytes.
    """
    helpers = ["w", "o", "b", "r", "m", "open", "two", "once"]
    if clash := [c for c in words.columns if c in helpers]:
        raise ValueError(f"columns of the words must not be called {clash}")
    rows = words.withColumn("w", F.col(word))
    for step in steps(SPARK):
        rows = rows.withColumns({name: F.expr(expression) for name, expression in step})
        if "m" in dict(step):
            rows = rows.withColumn("m", F.expr(_settled("m", SPARK)))
    return rows.select(*words.columns, F.col("w").alias(stem))


def stem_sql(words: str, word: str = "token") -> str:
    """DuckDB CTEs, without ``with``, of which the last, ``stems``, has ``word`` and its stem for the query ``words``."""
    out, have = [f"s0 as materialized (select {word}, {word} as w from ({words}))"], ["w"]
    for k, step in enumerate(steps(DUCKDB)):
        new = dict(step)
        kept = [c for c in have if c not in new]
        columns = ", ".join([word, *kept, *(f"{e} as {c}" for c, e in new.items())])
        out.append(f"s{k + 1} as materialized (select {columns} from s{k})")
        have = [*kept, *new]
    out.append(f"stems as materialized (select {word}, w as stem from s{len(out) - 1})")
    return ",\n".join(out)
