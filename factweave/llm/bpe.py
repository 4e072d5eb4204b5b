"""Byte-level BPE: exact merges in linear time, and decoding by an offset table.

The encoder backtracks. Aho-Corasick matching finds the longest token at a place, from no more bytes than the longest
token has, so the work for a token does not depend on what it stands in. Walking from the left, a token is taken if it is
compatible with the one before it, that is, if merging in rank order would not have joined across their border. Otherwise
the next shorter token is tried, and if none is left the token before is given up; a position that led nowhere is never
entered again, which keeps the time linear. The only sequence in which all neighbours are compatible is the one that the
merges make.

Decoding gathers bytes: the bytes of all tokens lie in one blob, and an offset table says where each token's are.

Defined cases: a null text is the empty text, with no tokens; strings of added tokens inside a text become their ids, as
in the library; repeated rows are encoded each; an empty table gives an empty result; other columns are ignored here. Long
texts pass in segments that end at white space. What is remembered is bounded in number and in characters; units above
`LONG_UNIT` characters are encoded each time, as they seldom repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .chunks import PieceNumbers, RaggedPool, byte_groups, keep_nothing, kept, ragged_take, texts_of
from .staging import free_name
from .token_counts import _ANY_WHITE, segments

REMEMBERED, LONG_UNIT = 400_000, 64
SEGMENT_CHARS = 1 << 20
#: Bytes of text whose ids and decoded text are handed on at once.
OUTPUT_BYTES = 4 << 20

#: The public pattern that cuts text before the merges.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class MergeTable:
    """Tokens in rank order: 0 to 255 are bytes, then one token for each merge."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]]) -> None:
        import ahocorasick

        letters = byte_letters()
        byte_of = {x: b for b, x in enumerate(letters)}
        rank = {x: b for b, x in enumerate(letters)}
        self.text = [bytes([b]) for b in range(256)]
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        self.ids = [vocabulary[x] for x in letters]
        for left, right in merges:
            pair, whole, number = (rank[left], rank[right]), left + right, len(self.text)
            if whole in rank:  # a second way to a known token keeps the first one's rank
                continue
            rank[whole] = self.joined[pair] = number
            self.halves.append(pair)
            self.text.append(bytes(byte_of[c] for c in whole))
            self.ids.append(vocabulary[whole])
        self.length = list(map(len, self.text))
        self.longest = max(self.length)
        by_text = {x: n for n, x in enumerate(self.text)}
        self.shorter = [next((by_text[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in by_text), -1) for x in self.text]
        self.automaton = ahocorasick.Automaton()
        for n, x in enumerate(self.text):
            self.automaton.add_word(x.decode("latin-1"), n)
        self.automaton.make_automaton()
        self.checked: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges in rank order leave a border between these two tokens."""
        known = self.checked.get((left, right))
        if known is None:
            if len(self.checked) > 400_000:
                self.checked.clear()
            known = self.checked[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo merges at the border, latest first; `before` is the rank below which a merge across it would have come first.
        joined, halves, before = self.joined, self.halves, len(self.text)
        while True:
            across = joined.get((left, right))
            if across is not None and across < before:
                return False
            if left > right:
                if left < 256:
                    return True
                before, left = left, halves[left][1]
            elif right < 256:
                return True
            else:
                before, right = right + 1, halves[right][0]

    def encode(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        text, size, length, compatible, most = piece.decode("latin-1"), len(piece), self.length, self.compatible, self.longest
        longest = self.automaton.iter_long  # every byte is a token, so the first match from a place starts there
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        place, token = 0, next(longest(text[:most]))[1]
        while True:
            end = place + length[token]
            if alive[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == size:
                    return out
                place, token = end, next(longest(text[end : end + most]))[1]
                continue
            shorter = self.shorter[token]
            if shorter >= 0:
                token = shorter
            else:
                alive[place] = 0
                token = out.pop()
                place -= length[token]


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, model_path: str, remembered: int = REMEMBERED) -> None:
        import regex

        with open(model_path, encoding="utf-8") as file:
            model = json.load(file)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self.table = MergeTable(model["model"]["vocab"], merges)
        self.id_of_rank = np.array(self.table.ids, np.int32)
        added = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        self.added = added
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(PIECE_PATTERN)
        texts = {i: t for i, t in zip(self.table.ids, self.table.text, strict=True)} | {i: t.encode() for t, i in added.items()}
        by_id = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        self.decimals = [str(i) for i in range(len(by_id))]
        self.remembered = remembered
        self.units: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        # Pieces between single spaces; a text with other white space at such a cut takes the slower way.
        self.numbers = PieceNumbers(lambda x: bool(x) and not x[0].isspace() and not x[-1].isspace())
        self.pool = RaggedPool(np.int32)

    def _forget_at_limit(self) -> None:
        if self.numbers.forget_at(self.remembered):
            self._forget()
        if len(self.units) > self.remembered:
            self.units.clear()

    def _ranks(self, piece: str) -> bytes:
        """Ranks of a piece's tokens as 32-bit numbers, packed, since very many are remembered."""
        parts = []
        for unit in self.pattern.findall(piece):
            known = self.units.get(unit)
            if known is None:
                known = array("i", self.table.encode(unit.encode())).tobytes()
                if len(unit) <= LONG_UNIT:
                    self.units[unit] = known
            parts.append(known)
        return b"".join(parts)

    def _encode_pending(self) -> None:
        if not self.numbers.pending:
            return
        found = [self._ranks(" " + piece) for piece in self.numbers.pending]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.pool.extend(self.id_of_rank[np.frombuffer(b"".join(found), np.int32)], sizes)
        self.numbers.pending.clear()

    def _plain(self, piece: str) -> np.ndarray:
        return self.id_of_rank[np.frombuffer(self._ranks(piece), np.int32)]

    def _ordinary(self, text: str) -> list[np.ndarray]:
        """Ids of a text without added tokens. The first piece has no space before it, all others have the one they were cut at."""
        out = []
        for k, part in enumerate(segments(text, SEGMENT_CHARS, _ANY_WHITE)):
            head, *rest = part.split(" ")
            numbers = np.fromiter(map(self.numbers.__getitem__, rest), np.int64, len(rest))
            if not head or head[-1].isspace() or len(numbers) and numbers.min() < 0:
                head, *rest = _ANY_WHITE.split(part)
                numbers = np.fromiter(map(self.numbers.force, rest), np.int64, len(rest))
            self._encode_pending()
            out += [self._plain(" " + head if k else head), self.pool.take(numbers)]
            self._forget_at_limit()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids that the library gives for this text without added special tokens."""
        parts = []
        for k, part in enumerate(self.added_split.split(text) if self.added_split and text else [text]):
            parts += [np.array([self.added[part]], np.int32)] if k % 2 else self._ordinary(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        return ragged_take(self.blob, starts, self.offsets[ids + 1] - starts).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def bpe_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids alone. No shuffle."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("byte bpe", model_path), lambda: ByteBpe(model_path))
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for x in texts_of(batch.column(1)):
                ids = own.encode(x)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(own.decimals.__getitem__, ids.tolist())).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(digest, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with token_ids array<int> of the whole text and decoded, the text that the ids decode to; names that are taken get underscores."""
    name, back = free_name(docs, "token_ids"), free_name(docs, "decoded")

    at = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        own = ByteBpe(model_path, REMEMBERED // 2)  # ids and texts take memory too
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_pylist()
            for first, last in byte_groups(sizes, OUTPUT_BYTES):
                batch = whole.slice(first, last - first)
                found = [own.encode(x) for x in texts_of(batch.column(at))]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                decoded = pa.array([own.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], names=[*batch.schema.names, name, back])
        own = whole = batch = found = ids = decoded = None
        keep_nothing()

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(encode, f"{schema}, `{name}` array<int>, `{back}` string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab.path("byte_bpe_50k.json"))
