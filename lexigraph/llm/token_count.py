"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text up to ``chunk`` characters is encoded at once. A longer one is encoded in chunks that overlap, with the offsets
of their tokens, so that memory stays bounded by the chunk. Neighbouring chunks are spliced at a boundary that

* both chunks have between two tokens,
* lies between two characters that no word of the split pattern has side by side: any character but white space and
  white space after it, a letter and a digit, or a letter or digit and punctuation, in either order, but for an
  apostrophe before a letter. Every alternative of the pattern ends there, and none looks behind, so all later words
  depend on the text from there on alone, and
* lies before the first chunk's end by more than the longest special string, so no special string that the end cuts
  and no look-ahead reaches it.

Such a boundary is one of the whole text's as well, so the spliced tokens are those of the whole text. Where an overlap
has none, it is doubled; where even the rest of the chunk has none, as in a huge run of letters alone, which is one word
to the library too, the two are encoded as one piece of twice the length, so that time stays in proportion.

Null and empty texts have no tokens. Repeated rows are counted each, an empty table gives an empty result, and columns
other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexigraph.llm.blocks import sliced, texts
from lexigraph.llm.bpe import Vocabulary, read_vocabulary
from lexigraph.llm.scratch import table

#: White space as the vocabularies' pattern has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters, digits and punctuation, those that are so in every version of Unicode: a part of each class will do.
LETTER = r"A-Za-zÀ-ÖØ-öø-ÿА-яぁ-ゖァ-ヺ一-龥가-힣"
DIGIT = r"0-9"
MARK = r"!-&(-/:-@\[-`{-~、。「」！，？"
EDGE = re.compile(
    f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{LETTER}])(?=[{DIGIT}{MARK}'])|(?<=[{DIGIT}])(?=[{LETTER}{MARK}'])|(?<=[{MARK}])(?=[{LETTER}{DIGIT}])|(?<=')(?=[{DIGIT}])"
)
CHUNK, OVERLAP = 32_768, 256


class Counter:
    def __init__(self, source: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.vocabulary = Vocabulary(source)
        self.lengths = np.array([len(x) for x in self.vocabulary.pieces.to_pylist()])
        self.margin = 1 + max([1, *map(len, self.vocabulary.special)])
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)

    def ids(self, text: str) -> list[int]:
        return self.vocabulary.encode_text(text)

    def ends(self, text: str) -> np.ndarray:
        """Offsets in bytes of the tokens' ends."""
        return np.cumsum(self.lengths[np.array(self.ids(text), dtype=np.int64)])

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.ids(text))
        total, done = 0, 0  # tokens before, and the place of, the last splice
        start, end = 0, self.chunk  # of the chunk at hand
        ends = self.ends(text[:end])
        while end < len(text):
            place, overlap = None, self.overlap
            until = min(len(text), end + max(self.chunk, end - done))
            while place is None and overlap < 2 * (end - done):
                begin = max(done, end - overlap)
                edges = [m.start() for m in EDGE.finditer(text, begin + 1, max(begin + 1, end - self.margin + 1))]
                if edges:
                    following = self.ends(text[begin:until])
                    place = next((p for p in reversed(edges) if self._at(ends, text, start, p) and self._at(following, text, begin, p)), None)
                overlap *= 2
            if place is None:  # nothing to splice at: both chunks as one piece, from the last splice on
                start, end = done, until
                ends = self.ends(text[start:end])
                continue
            total += self._between(ends, text, start, done, place)
            done, start, end, ends = place, begin, until, following
        return total + self._between(ends, text, start, done, len(text))

    @staticmethod
    def _at(ends: np.ndarray, text: str, start: int, place: int) -> bool:
        offset = len(text[start:place].encode("utf-8", "surrogatepass"))
        k = np.searchsorted(ends, offset)
        return bool(k < len(ends) and ends[k] == offset)

    @staticmethod
    def _between(ends: np.ndarray, text: str, start: int, a: int, b: int) -> int:
        low = len(text[start:a].encode("utf-8", "surrogatepass"))
        high = low + len(text[a:b].encode("utf-8", "surrogatepass"))
        return int(np.searchsorted(ends, high, "right") - np.searchsorted(ends, low, "right"))


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, chunk)
        for batch in sliced(batches):
            rows = texts(batch.column("__text"))
            sizes = pa.array([len(x) if x.isascii() else len(x.encode()) for x in rows], pa.int64())
            counts = pa.array([counter.count(x) for x in rows], pa.int64())
            over = pa.array([n > limit for n in counts.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, counts, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
