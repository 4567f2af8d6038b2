"""Chat formatting by schema fingerprints.

A record (JSON) is reduced to the set of its nested field paths; the hash of that set selects a declarative mapping,
which lists where the turns of such a record stand. Fields that describe a record, such as an id, don't count. The turns
are then written with a template whose control strings cannot occur in a text: the characters that begin one are
escaped, reversibly. Spans of assistant text are marked as the loss mask.

``shaped_records`` makes such records of conversations given as rows of turns, in the layout that each one's roles allow.

Records of unknown layout keep a row, with a null layout and no turns. Null texts and roles are empty. Invalid JSON is
an unknown layout. Turns of a conversation are ordered by turn, then role and text; nulls come first; repeated rows are
turns of their own. An empty table gives an empty result. A conversation is a row in one task's memory, however long its
texts. Further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.blocks import sliced
from lexigraph.llm.scratch import table

Turn = tuple[str, str]

# Fingerprints


def field_paths(value: Any, at: str = "") -> set[str]:
    """Paths to all leaves: keys after a dot, lists as []; empty lists and objects are leaves."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Paths, and what lies below them, that don't count in a fingerprint.
DESCRIPTION = (".id", ".source", ".metadata", ".tags", ".created")


def counted(paths: Iterable[str], ignored: Iterable[str] = DESCRIPTION) -> set[str]:
    return {p for p in paths if not any(p == x or p.startswith((x + ".", x + "[")) for x in ignored)}


# Mappings


@dataclass(frozen=True)
class Said:
    """One turn: the texts at ``fields``, those that aren't empty, joined by a blank line."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list at ``field``; roles are renamed by ``names``."""

    field: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    name: str
    paths: frozenset[str]
    turns: tuple[Said | Each, ...]

    def apply(self, record: Any) -> list[Turn]:
        found: list[Turn] = []
        for rule in self.turns:
            if isinstance(rule, Said):
                found.append((rule.role, "\n\n".join(x for x in (_text(record.get(f)) for f in rule.fields) if x)))
            else:
                names = dict(rule.names)
                turns = record.get(rule.field) if rule.field else record
                found += [(names.get(_text(t.get(rule.role)), _text(t.get(rule.role))), _text(t.get(rule.text))) for t in turns]
        return found


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _flat(name: str, *turns: Said) -> Mapping:
    return Mapping(name, frozenset(f".{f}" for t in turns for f in t.fields), turns)


def _list(name: str, field: str, role: str, text: str, names: dict[str, str] | None = None, more: tuple[Said, ...] = (), empty: bool = False) -> Mapping:
    at = f".{field}[]" if field else "[]"
    own = {at} if empty else {f"{at}.{role}", f"{at}.{text}"}
    paths = frozenset(own | {f".{f}" for t in more for f in t.fields})
    return Mapping(name, paths, (*more, *(() if empty else (Each(field, role, text, tuple((names or {}).items())),))))


SHARED_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
SYSTEM = Said("system", ("system",))
MAPPINGS: tuple[Mapping, ...] = (
    *(
        _flat(f"{kind}{'_system' * bool(before)}", *before, Said("user", tuple(asked)), Said("assistant", (answer,)))
        for before in ((), (SYSTEM,))
        for kind, asked, answer in (
            ("prompt_response", ["prompt"], "response"),
            ("prompt_completion", ["prompt"], "completion"),
            ("question_answer", ["question"], "answer"),
            ("instruction_output", ["instruction"], "output"),
            ("instruction_input_output", ["instruction", "input"], "output"),
            ("instruction_response", ["instruction"], "response"),
            ("instruction_context_response", ["instruction", "context"], "response"),
        )
    ),
    *(
        _list(f"{field or 'list'}_{role}{'_system' * bool(before)}{'_empty' * empty}", field, role, text, names, before, empty)
        for before in ((), (SYSTEM,))
        for field, role, text, names in (
            ("messages", "role", "content", None),
            ("conversations", "from", "value", SHARED_NAMES),
            ("conversation", "role", "content", SHARED_NAMES),
            ("turns", "speaker", "text", SHARED_NAMES),
            ("", "role", "content", None),
        )
        for empty in (False, True)
        if field or not before
    ),
)


def canonical(record: str | None, by_print: dict[str, Mapping]) -> tuple[str | None, str, list[Turn]]:
    """Layout, fingerprint and turns of a record; layout None if it is unknown."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None, "", []
    print_ = fingerprint(counted(field_paths(value)))
    mapping = by_print.get(print_)
    return (mapping.name, print_, mapping.apply(value)) if mapping else (None, print_, [])


# Template

START, END = "<|turn|>", "<|end|>"
#: Every control string, of this template and of the common ones, begins with one of these.
_OPENING = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)|([<\[])\\", re.S)


def escaped(text: str) -> str:
    """Each < and [ with a backslash after it, each backslash doubled."""
    return _OPENING.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[2] or ("\n" if m[1] == "n" else m[1]), text)


def formatted(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation in the template, and the spans of assistant text in it."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head = START + escaped(role).replace("\n", "\\n") + "\n"
        body = escaped(text)
        parts += [head, body, END]
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), loss


def parsed(conversation: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    turns = []
    for part in conversation.split(END)[:-1]:
        head, _, body = part.removeprefix(START).partition("\n")
        turns.append((unescaped(head), unescaped(body)))
    return turns


# Tables


def format_records(records: DataFrame, record: str = "record", key: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """key, layout, fingerprint, turns, formatted, loss (spans in formatted) of each JSON record."""
    by_print = {fingerprint(m.paths): m for m in mappings}
    if len(by_print) < len(mappings):
        raise ValueError("two mappings for one layout")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        kinds = [pa.string(), pa.string(), pa.list_(turn), pa.string(), pa.list_(span)]
        for batch in sliced(batches):
            out = []
            for x in batch.column("record").to_pylist():
                layout, print_, turns = canonical(x, by_print)
                text, loss = formatted(turns)
                out.append((layout, print_, [{"role": r, "text": t} for r, t in turns], text, [{"start": a, "end": b} for a, b in loss]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "layout", "fingerprint", "turns", "formatted", "loss"])

    kind = records.schema[key].dataType.simpleString()
    types = "layout string, fingerprint string, turns array<struct<role:string,text:string>>, formatted string, loss array<struct<start:int,end:int>>"
    chosen = records.select(records[key].alias("key"), records[record].alias("record"))
    return chosen.mapInArrow(run, f"key {kind}, {types}").withColumnRenamed("key", key)


def shaped_records(rows: DataFrame) -> DataFrame:
    """conv_id and record: the rows (conv_id, turn, role, text) of each conversation in the layout that its roles allow.

    One question and its answer are a prompt and a response, with a system text an instruction and its output. Of longer
    ones with the usual roles, those that begin with the only system text have it apart; an odd number of turns makes
    a bare list, a multiple of four a list of speakers, other numbers a list of who it is from. All others are messages.
    """
    blank = lambda c: F.coalesce(rows[c], F.lit(""))
    message = F.struct(rows["turn"].alias("turn"), blank("role").alias("role"), blank("text").alias("content"))
    ordered = rows.select(rows["conv_id"].alias("conv_id"), message.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    ordered = ordered.withColumn("roles", F.col("m.role"))
    text = lambda k: F.get("m", F.lit(k))["content"]
    is_ = lambda *roles: F.col("roles") == F.array(*[F.lit(r) for r in roles])
    said = lambda who, what, names: F.transform(
        F.filter("m", lambda m: m["role"] != "system") if "system" not in names else F.col("m"),
        lambda m: F.struct(F.coalesce(*[F.when(m["role"] == r, F.lit(n)) for r, n in names.items()], m["role"]).alias(who), m["content"].alias(what)),
    )
    usual = F.forall("roles", lambda r: r.isin("user", "assistant", "system"))
    apart = usual & (F.get("roles", F.lit(0)) == "system") & (F.size(F.filter("roles", lambda r: r == "system")) == 1) & (F.size("m") > 1)
    human = {"user": "human", "assistant": "gpt"}
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(apart, F.to_json(F.struct(text(0).alias("system"), said("from", "value", human).alias("conversations"))))
        .when(usual & (F.size("m") % 2 == 1), F.to_json(said("role", "content", {"system": "system"})))
        .when(usual & (F.size("m") % 4 == 0), F.to_json(F.struct(said("speaker", "text", {"user": "human", "assistant": "bot", "system": "system"}).alias("turns"))))
        .when(usual, F.to_json(F.struct(said("from", "value", human | {"system": "system"}).alias("conversations"))))
        .otherwise(F.to_json(F.struct(said("role", "content", {"system": "system"}).alias("messages"))))
    )
    return ordered.select("conv_id", record.alias("record"))


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """conv_id, layout, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and its loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parsed(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, loss)]
                out.append((len(turns), digests[0], len(loss), digests[1], len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("layout"), *columns], names)

    names = ["conv_id", "layout", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted_rows.schema["conv_id"].dataType.simpleString()
    types = "layout string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted_rows.select("conv_id", "layout", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, {types}")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 1, "user", said), (-1, 2, "assistant", said)], rows.schema)
    return read_back(format_records(shaped_records(rows.unionByName(extra))))


ORACLE = r"""
with c as (
  select conv_id, turn, role, text from conversations
  union all values (-1, 1, 'user', '</s>[INST] ok [/INST]'), (-1, 2, 'assistant', '</s>[INST] ok [/INST]')
), d as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         '<|turn|>' || replace(replace(replace(coalesce(role, ''), '\', '\\'), '<', '<\'), '[', '[\') || chr(10)
           || replace(replace(replace(coalesce(text, ''), '\', '\\'), '<', '<\'), '[', '[\') || '<|end|>' as f
  from c
)
select conv_id,
       case when roles = ['user', 'assistant'] then 'prompt_response'
            when roles = ['system', 'user', 'assistant'] then 'instruction_output_system'
            when n_other > 0 then 'messages_role'
            when roles[1] = 'system' and len(roles) > 1 and n_system = 1 then 'conversations_from_system'
            when len(roles) % 2 = 1 then 'list_role' when len(roles) % 4 = 0 then 'turns_speaker' else 'conversations_from' end as layout,
       * exclude (conv_id, roles, n_other, n_system)
from (select conv_id, list(role order by turn, role, text) as roles,
       count(*) filter (where role not in ('user', 'assistant', 'system')) as n_other,
       count(*) filter (where role = 'system') as n_system, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(f))::bigint as formatted_chars
from d group by conv_id)
"""
