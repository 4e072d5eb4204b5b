"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts reach Python in Arrow batches of bounded bytes. They are cut at safe boundaries, places where no piece of the
vocabulary can cross: a single space between two characters that are neither a space nor its visible mark. Pieces
between boundaries repeat, so each distinct one is encoded once per worker, in batches balanced by bytes. Very long
texts pass through in segments that end at a safe boundary, so memory follows the segment and not the text.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows are counted each; an empty table gives an
empty result; further columns of the input are ignored. A text without any safe boundary is encoded in one call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .chunks import PieceNumbers, byte_groups, keep_nothing, texts_of

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 700_000
#: Bytes of text between two calls of the encoder.
GROUP_BYTES = 4 << 20
#: Characters of a text that are handled at once.
SEGMENT_CHARS = 1 << 20

_BOUNDARY = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_ANY_WHITE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, limit: int, boundary: re.Pattern = _BOUNDARY) -> Iterator[str]:
    """The text in parts of about `limit` characters; the space at each cut is left out."""
    start = 0
    while len(text) - start > limit:
        cut = boundary.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


def _plain(piece: str) -> bool:
    return bool(piece) and piece[0] != "▁" and piece[-1] != "▁"


class PieceModelCounter:
    """Counts of a sentencepiece model whose pieces hold the space mark at their start only."""

    def __init__(self, model_path: str, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(re.search("[^▁]▁", x) for x in pieces)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = PieceNumbers(_plain), np.zeros(0, np.int32)

    def _numbers(self, text: str) -> np.ndarray:
        pieces = text.split(" ") if self.splits else [text] if text else []
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if len(numbers) and numbers.min() < 0:  # runs of spaces, or spaces at an end
            pieces = [x for x in _BOUNDARY.split(text) if x]
            numbers = np.fromiter(map(self.numbers.force, pieces), np.int64, len(pieces))
        return numbers

    def _encode_pending(self) -> None:
        if self.numbers.pending:
            found = self.model.encode(self.numbers.pending, num_threads=1)
            self.known = np.concatenate([self.known, np.fromiter(map(len, found), np.int32, len(found))])
            self.numbers.pending.clear()

    def counts(self, texts: Iterator[str]) -> list[int]:
        held = []
        for text in texts:
            total, last = 0, None
            for part in segments(text, SEGMENT_CHARS):
                if last is not None:
                    self._encode_pending()
                    total += int(self.known[last].sum())
                last = self._numbers(part)
            held.append((total, last))
        self._encode_pending()
        out = [total + int(self.known[last].sum()) for total, last in held]
        if self.numbers.forget_at(self.remembered):
            self._forget()
        return out


class JsonModelCounter:
    """Counts of a file of the tokenizers library, each text encoded whole."""

    def __init__(self, model_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model_path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: Iterator[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(list(texts), add_special_tokens=False)]


def counter(model_path: str) -> PieceModelCounter | JsonModelCounter:
    return JsonModelCounter(model_path) if model_path.endswith(".json") else PieceModelCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row. No shuffle; only lengths leave Python."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        own = counter(model_path)
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            counts: list[int] = []
            for first, last in byte_groups(sizes.to_pylist(), GROUP_BYTES):
                counts += own.counts(texts_of(column.slice(first, last - first)))
            counted = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counted, pc.greater(counted, limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab.path("piece_bpe_32k.model"))
