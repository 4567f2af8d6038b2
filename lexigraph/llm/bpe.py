"""BPE encoding and decoding by a table of distinct words.

Spark splits the texts into words with the tokenizer's own pattern and counts, over the whole corpus, the rows that each
distinct word is in. The words of most rows, up to TABLE_WORDS, make a table: each is encoded once, and the table, whose
size that number bounds, goes to all tasks. An Arrow batch of documents finds its distinct words there and, block by
block, joins their ids back to the words' positions; decoding joins the ids to the table of pieces in the same way. Words
beyond the table, which few rows have, are encoded once in each batch that has them: to give these one table too, their
positions and, to meet them again, all texts would have to be shuffled (see the README). Every word of every text is encoded in either way.

The JVM's tables of Unicode may be older than the library's. A text with a code point that they don't know is not split
but encoded whole, by the library's own pattern.

The vocabulary is a byte-level BPE file of the tokenizers library; what the driver sends is its fixed size. Null texts
count as empty and have no tokens. Special strings in a text get their special ids, as in the library. Repeated rows
are encoded each; an empty table gives an empty result; a very long text makes a block of its own. Of further columns,
one that has the name of a result is replaced, and all others stay as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.scratch import materialise, table

#: The split pattern of byte-level BPE (fixed value); (?U) makes Java's \s that of Unicode.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Python's engines.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a block, whose ids and bytes are in memory at once; a longer text is a block alone.
BLOCK_WORDS = 1 << 16
#: Words that are Python strings at once.
STEP = 1 << 14
#: Words of the corpus's table, at most.
TABLE_WORDS = 1 << 18
#: A code point that the JVM's tables of Unicode don't have.
UNKNOWN = r"\p{Cn}"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Pieces by id, special strings, and an encoder of words, from a tokenizers file's JSON."""

    def __init__(self, source: str):
        import tiktoken

        spec = json.loads(source)
        letters = byte_letters()
        pieces = {i: bytes(letters[c] for c in word) for word, i in spec["model"]["vocab"].items() if all(c in letters for c in word)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {piece: i for i, piece in pieces.items() if i not in self.special.values()}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        pieces |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.large_binary())
        self.newline = self.encoding.encode_ordinary("\n")
        self.source, self.slow = source, None

    def encode_text(self, text: str) -> list[int]:
        """The ids of a whole text, special strings included."""
        try:
            if any(s in text for s in self.special):
                return self.encoding.encode(text, allowed_special="all", disallowed_special=())
            return self.encoding.encode_ordinary(text)
        except BaseException as error:
            # A run of white space beyond the fast engine's stack, which it reports as a ValueError or a panic.
            if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.source)
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's ids start (one more at the end).

        A word that isn't white space ends before any white space, so words between newlines are encoded as alone,
        all in one call; a newline is a token of its own there and nowhere else.
        """
        ids: list[np.ndarray | None] = [None] * len(words)
        plain = []
        for i, word in enumerate(words):
            if word in self.special:
                ids[i] = np.array([self.special[word]])
            elif word.isspace() or "\n" in word or len(self.newline) != 1:
                ids[i] = np.array(self.encode_text(word))
            else:
                plain.append(i)
        together = np.array(self.encoding.encode_ordinary("\n".join(words[i] for i in plain)), dtype=np.int64)
        parts = np.split(together, np.flatnonzero(together == self.newline[0])) if plain else []
        if len(parts) == len(plain):
            for k, i in enumerate(plain):
                ids[i] = parts[k][1:] if k else parts[k]
        else:  # white space that Python and the pattern see differently stood in a word
            for i in plain:
                ids[i] = np.array(self.encode_text(words[i]))
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0)).astype(np.int64), starts


def split_words(text: Column, special: list[str]) -> Column:
    """The words of each text in order; special strings are words, and white space before one ends the text.

    A text with a code point that is UNKNOWN is one word.
    """
    text = F.coalesce(text, F.lit(""))
    words = lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    split = lambda found: F.when(text.rlike(UNKNOWN), F.array(text)).otherwise(found)
    if not special:
        return split(words(text))
    longest = sorted(special, key=len, reverse=True)
    either = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", s) for s in longest)
    between = F.transform(F.split(text, either, -1), words)
    found = F.transform(F.regexp_extract_all(text, F.lit(either), F.lit(0)), lambda s: F.array(s))
    paired = F.flatten(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<string>")))))
    any_special = F.lit(False)
    for s in longest:
        any_special = any_special | text.contains(s)
    return split(F.when(any_special, paired).otherwise(words(text)))


def common_words(words: DataFrame, most: int = TABLE_WORDS, column: str = "__words") -> DataFrame:
    """word: those that most rows of ``words`` have, up to ``most`` of those that more than one row has.

    Counted over all rows, within tasks first. Steps of frequency are taken from the top as long as they fit, so the
    driver reads some hundred sums.
    """
    counts = words.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("step")), "words")
    least, total = None, 0
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return counts.where(F.col("step") >= (1 << 30 if least is None else least)).select("word")


def encoded_words(words: DataFrame, source: Broadcast) -> DataFrame:
    """word, ids of each of the distinct ``words`` (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(source.value)
        for batch in batches:
            ids, starts = vocabulary.encode_words(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


class WordTable:
    """Distinct words, their ids in a row, and where each word's ids start (one more at the end)."""

    def __init__(self, encoded: pa.Table):
        encoded = encoded.combine_chunks()
        one = lambda c, kind: c.chunk(0) if c.num_chunks else pa.array([], kind)
        self.words = one(encoded.column("word"), pa.string())
        ids = one(encoded.column("ids"), pa.list_(pa.int32()))
        self.ids = np.asarray(ids.flatten()).astype(np.int64)
        self.starts = np.asarray(ids.offsets).astype(np.int64) - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int64)

    def runs(self, vocabulary: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of ``words`` where its own begin among them and how many it has."""
        found = pc.index_in(words, value_set=self.words)
        miss = np.asarray(found.is_null())
        at = np.asarray(found.fill_null(0)).astype(np.int64)
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[~miss], count[~miss] = self.starts[at[~miss]], np.diff(self.starts)[at[~miss]]
        parts, size, places = [self.ids], len(self.ids), np.flatnonzero(miss)
        for k in range(0, len(places), STEP):
            some = places[k : k + STEP]
            ids, starts = vocabulary.encode_words(words.take(pa.array(some)).to_pylist())
            begin[some], count[some] = size + starts[:-1], np.diff(starts)
            parts.append(ids)
            size += len(ids)
        return np.concatenate(parts), begin, count


def _gathered(values: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``values`` at ``index`` in a row, and their bounds."""
    taken = values.take(pa.array(index))
    bounds = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1]
    data = taken.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def word_blocks(bounds: np.ndarray, most: int = BLOCK_WORDS) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) rows of blocks with about ``most`` words together, at least one row."""
    start = 0
    while start < len(bounds) - 1:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield start, end
        start = end


def encoded_blocks(vocabulary: Vocabulary, known: WordTable, batches: Iterator[pa.RecordBatch], most: int = BLOCK_WORDS) -> Iterator[tuple]:
    """Rows of the batches, their ids in a row, and each document's bounds in these.

    A batch's distinct words get their ids once; its documents then follow in blocks.
    """
    for batch in batches:
        words = batch.column("__words")
        bounds = np.asarray(words.offsets, dtype=np.int64)
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        at = np.asarray(coded.indices)
        ids, begin, count = known.runs(vocabulary, coded.dictionary)
        for start, end in word_blocks(bounds, most):
            # Join by position: word k of the text gets the run of ids that its distinct word has.
            here = at[bounds[start] : bounds[end]]
            counts = count[here]
            ends = np.concatenate([[0], np.cumsum(counts)])
            place = np.repeat(begin[here] - ends[:-1], counts)
            place += np.arange(ends[-1])
            yield batch.slice(start, end - start), ids[place], ends[bounds[start : end + 1] - bounds[start]]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``ids``, an array of the text's token ids."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "ids"]
    sent, split = _sent(docs, path, text, keep, table_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Vocabulary(sent.value[0]), WordTable(sent.value[1])
        for batch, ids, bounds in encoded_blocks(vocabulary, known, batches):
            column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], column], [*keep, "ids"])

    return split.mapInArrow(run, _types(docs, keep) + "ids array<int>")


def decode(tokens: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ids by default) with ``decoded``, the text of the ids; null counts as no ids."""
    keep = [c for c in (tokens.columns if keep is None else keep) if c.lower() != "decoded" and (keep is not None or c != ids)]
    sent = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Vocabulary(sent.value).pieces
        for batch in batches:
            lists = batch.column("__ids")
            bounds = np.asarray(lists.offsets, dtype=np.int64)
            flat = np.asarray(lists.values.slice(bounds[0], bounds[-1] - bounds[0]), dtype=np.int64)
            data, ends = _gathered(pieces, flat)
            marks = ends[bounds - bounds[0]]
            decoded = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(marks[:-1], marks[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(decoded, pa.string())], [*keep, "decoded"])

    filled = tokens.select(*keep, F.coalesce(ids, F.array().cast("array<int>")).alias("__ids"))
    return filled.mapInArrow(run, _types(tokens, keep) + "decoded string")


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, without the ids ever being rows of Spark."""
    sent, split = _sent(docs, path, text, [doc_id], table_words)
    types = f"{_types(docs, [doc_id])}n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Vocabulary(sent.value[0]), WordTable(sent.value[1])
        written = pa.array([f"{i},".encode() for i in range(len(vocabulary.pieces))], pa.large_binary())
        for batch, ids, bounds in encoded_blocks(vocabulary, known, batches):
            out: list[list] = [[], []]
            for k, (values, cut) in enumerate(((written, 1), (vocabulary.pieces, 0))):
                data, ends = _gathered(values, ids)
                marks = ends[bounds]
                for a, b in zip(marks[:-1], marks[1:], strict=True):
                    found = data[a : max(a, b - cut)]
                    if k:  # as the library decodes: bytes that are no UTF-8 are replaced
                        found = found.tobytes().decode("utf-8", "replace").encode()
                    out[k].append(hashlib.sha256(found).hexdigest())
            columns = [batch.column(doc_id), pa.array(np.diff(bounds)), pa.array(out[0]), pa.array(out[1])]
            yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return split.mapInArrow(run, types)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _types(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""


def _sent(docs: DataFrame, path: str, text: str, keep: list[str], table_words: int) -> tuple[Broadcast, DataFrame]:
    """Vocabulary and word table for the tasks, and the rows with their words."""
    source = read_vocabulary(path)
    special = [t["content"] for t in json.loads(source)["added_tokens"]]
    split = docs.select(*keep, split_words(F.col(text), special).alias("__words"))
    send = docs.sparkSession.sparkContext.broadcast
    # The table's rows, ``table_words`` at most, pass the driver as Arrow data.
    return send((source, encoded_words(common_words(split, table_words), send(source)).toArrow())), split


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
