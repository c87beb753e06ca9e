"""Token counts of whole texts under a SentencePiece BPE model, by the whole-token shortcut.

No piece of the model has a space mark after another character, so merges never cross from one
pre-token (a run of space marks with what follows it up to the next mark) into another, and the
count of a text is the sum over its pre-tokens. Which pieces encode alone as one token is proved
beforehand by encoding each; pre-tokens among them are counted without merging, and only the rest
are merged (the results of short ones are kept in a bounded table).

Null and empty texts have no tokens. Repeated rows each get a row. Any U+2581 in a text acts as a
space, as it does in the library. Other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from huemill.llm.common import ids_of, id_array, texts_of

MARK = "▁"
#: Merged pre-tokens kept by one task at most, and the longest that is kept.
KEPT, KEPT_CHARS = 400_000, 64


def whole_tokens(processor: sentencepiece.SentencePieceProcessor) -> list[str]:
    """Pre-tokens, without their first space mark, that the model encodes as exactly one token."""
    found = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i):
            continue
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} joins two pre-tokens; counts can't be summed for this model")
        if piece.startswith(MARK):
            rest = piece[1:].replace(MARK, " ")
            if processor.encode(rest) == [i]:
                found.append(rest)
    return found


class PretokenCounts(dict):
    """Tokens of a pre-token given without its first space mark."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.processor, self.whole = processor, whole

    def __missing__(self, key: str) -> int:
        # a text that ends with one space has a space mark alone as its last pre-token; an empty text has no mark
        n = len(self.processor.encode(key)) if key else len(self.processor.encode("a ")) - len(self.processor.encode("a"))
        if len(key) <= KEPT_CHARS:
            if len(self) >= len(self.whole) + KEPT:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[key] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return sum(map(self.__getitem__, parts))
        total, marks = 0, 0
        for part in parts:
            if part:
                total += self[" " * marks + part]
                marks = 0
            else:
                marks += 1
        return total + (self[" " * (marks - 1)] if marks else 0)


def count_tokens(docs: DataFrame, limit: int = 4096, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, UTF-8 bytes, tokens, and whether these are more than limit."""
    with open(model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    proved = whole_tokens(sentencepiece.SentencePieceProcessor(model_proto=proto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PretokenCounts(sentencepiece.SentencePieceProcessor(model_proto=proto), proved)
        for batch in batches:
            texts = texts_of(batch.column(1))
            tokens = [counts.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [id_array(ids_of(batch.column(0))), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
