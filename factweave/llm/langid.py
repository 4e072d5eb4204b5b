"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, computed by a forward pass over its positions; a text's score is the sum over its words.
Expectation-maximisation learns the probabilities from word counts, with forward and backward passes.

The classifier is fitted on a bounded sample: for each language the `docs_per_lang` labelled documents with the least
hash of their key, whole texts, and of those the `words_per_lang` most frequent words of up to `letters_per_word` letters.
Prediction reads every row's
whole text and nothing but the text. It needs no shuffle; each distinct piece between spaces is scored once per worker.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the language that sorts first;
without labelled documents everything is `und`; letters outside the vocabulary share one piece; repeated rows are
predicted alike; an empty table gives an empty result; columns that are neither key, text nor label are ignored. Words of
any length are one lattice: where a product of chances could leave the range of doubles it is kept as a logarithm, and
words of many thousand letters pass the lattice in steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocab
from .chunks import PieceNumbers, keep_nothing, texts_of
from .staging import stage
from .token_counts import _ANY_WHITE, segments

UNKNOWN_LANG = "und"
#: Places of a long word that are looked up at once, and decades that a chance may fall without a logarithm.
STEP, DECADES = 1 << 14, 250
REMEMBERED = 250_000
SEGMENT_CHARS = 1 << 20
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORDS.findall(text.lower())
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found] if found else found


def letter_pieces(model_path: str) -> list[str]:
    """Pieces of a public vocabulary that consist of lower-case letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({x for x in pieces if (y := x.removeprefix("▁")).isalpha() and y == y.lower()} | {"▁"})


class Lattice:
    """Finds the pieces of many words at once. Number 0 is no piece, 1 any single letter outside the vocabulary."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces) + 2
        self.longest = max(map(len, pieces))
        self.by_length = {}
        for length in range(1, self.longest + 1):
            own = [(x, n + 2) for n, x in enumerate(pieces) if len(x) == length]
            if own:
                codes = np.array([x for x, _ in own], f"<U{length}").view(np.uint32).reshape(-1, length)
                keys = self._hash(codes)
                order = np.argsort(keys)
                self.by_length[length] = keys[order], np.array([n for _, n in own], np.int32)[order]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        key = np.zeros(codes.shape[:-1], np.uint64)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[-1]):
                key = (key + codes[..., k].astype(np.uint64) + np.uint64(1)) * _BASE
                key ^= key >> np.uint64(29)
        return key

    def find(self, words: list[str]) -> list[np.ndarray]:
        """For each piece length, the piece that starts at every position of words of one size."""
        width = len(words[0])
        codes = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
        out = []
        for length in range(1, min(width, self.longest) + 1):
            windows = np.lib.stride_tricks.sliding_window_view(codes, length, axis=1)
            if length not in self.by_length:
                out.append(np.zeros(windows.shape[:2], np.int32))
                continue
            keys, numbers = self.by_length[length]
            wanted = self._hash(windows)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out.append(np.where(keys[at] == wanted, numbers[at], 1 if length == 1 else 0).astype(np.int32))
        return out


def forward(found: list[np.ndarray], chances: np.ndarray) -> np.ndarray:
    """Probability of every prefix, [position, word, language], over all segmentations."""
    rows, width = found[0].shape
    ahead = np.zeros((width + 1, rows, chances.shape[1]))
    ahead[0] = 1
    for end in range(1, width + 1):
        for length in range(1, min(end, len(found)) + 1):
            ahead[end] += ahead[end - length] * chances[found[length - 1][:, end - length]]
    return ahead


def forward_log(lattice: Lattice, word: str, logs: np.ndarray) -> np.ndarray:
    """Log-probability of a whole word of any length by language, over all segmentations."""
    far, size = lattice.longest, len(word)
    ring = far + 1  # prefixes that a piece can still start from
    ahead = np.full((ring, logs.shape[1]), -np.inf)
    ahead[0] = 0
    for first in range(0, size, STEP):
        part = word[max(0, first - far) : min(size, first + STEP)]
        begin = max(0, first - far)
        found = lattice.find([part])
        for end in range(first + 1, min(size, first + STEP) + 1):
            most = min(end, far)
            pieces = np.array([found[length - 1][0, end - length - begin] for length in range(1, most + 1)])
            sums = ahead[(end - np.arange(1, most + 1)) % ring] + logs[pieces]
            top = sums.max(axis=0)
            ahead[end % ring] = top + np.log(np.exp(sums - top).sum(axis=0))
    return ahead[size % ring]


def by_size(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words, marked at their start, in blocks of one size."""
    places: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        places.setdefault(len(word) + 1, []).append(place)
    for size, own in places.items():
        step = max(1, min(most, 600_000 // size))
        for first in range(0, len(own), step):
            at = own[first : first + step]
            yield np.array(at), ["▁" + words[k] for k in at]


def fits(width: int, least: float) -> bool:
    """Whether no word of this width can have a chance below the range of doubles: all its letters may be cut one by one."""
    return width * -np.log10(least) < DECADES


def expected_log(found: list[np.ndarray], chances: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words too long for plain products: the same passes in logarithms."""
    with np.errstate(divide="ignore"):
        logs = np.log(chances)
    rows, width = found[0].shape
    ahead, behind = np.full((width + 1, rows), -np.inf), np.full((width + 1, rows), -np.inf)
    ahead[0] = behind[width] = 0
    for end in range(1, width + 1):
        for length in range(1, min(end, len(found)) + 1):
            ahead[end] = np.logaddexp(ahead[end], ahead[end - length] + logs[found[length - 1][:, end - length]])
    out = np.zeros(len(chances))
    for start in range(width - 1, -1, -1):
        for length in range(1, min(width - start, len(found)) + 1):
            piece = found[length - 1][:, start]
            behind[start] = np.logaddexp(behind[start], logs[piece] + behind[start + length])
            share = weight * np.exp(ahead[start] + logs[piece] + behind[start + length] - ahead[width])
            out += np.bincount(piece, share, len(chances))
    return out


class SegmentModel:
    """Languages and their piece probabilities."""

    def __init__(self, pieces: list[str], langs: list[str], chances: np.ndarray) -> None:
        self.pieces, self.langs, self.chances = pieces, langs, chances

    @classmethod
    def fit(cls, pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = 3, smooth: float = 0.1) -> SegmentModel:
        langs = sorted(counts)
        lattice = Lattice(pieces)
        chances = np.zeros((lattice.size, len(langs)))
        for k, lang in enumerate(langs):
            words = list(counts[lang])
            weights = np.array([counts[lang][w] for w in words], float)
            own = np.full((lattice.size, 1), 1 / (lattice.size - 1))
            own[0] = 0
            blocks = [(weights[at], lattice.find(part)) for at, part in by_size(words)]
            for _ in range(rounds):
                expected = np.zeros(lattice.size)
                for weight, found in blocks:
                    width = found[0].shape[1]
                    if not fits(width, own[1:].min()):
                        expected += expected_log(found, own[:, 0], weight)
                        continue
                    ahead = forward(found, own)[:, :, 0]
                    behind = np.zeros_like(ahead)
                    behind[width] = 1
                    for start in range(width - 1, -1, -1):
                        for length in range(1, min(width - start, len(found)) + 1):
                            behind[start] += own[found[length - 1][:, start], 0] * behind[start + length]
                    share = weight / ahead[width]
                    for length in range(1, len(found) + 1):
                        for start in range(width - length + 1):
                            piece = found[length - 1][:, start]
                            expected += np.bincount(piece, share * ahead[start] * own[piece, 0] * behind[start + length], lattice.size)
                expected[0] = 0
                own = ((expected + smooth) / (expected.sum() + smooth * (lattice.size - 1)))[:, None]
                own[0] = 0
            chances[:, k] = own[:, 0]
        return cls(pieces, langs, chances)


class Scorer:
    """Log-probabilities of texts for one worker."""

    def __init__(self, model: SegmentModel) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        with np.errstate(divide="ignore"):
            self.logs = np.log(model.chances)
        self.least = model.chances[1:].min() if model.langs else 1.0
        self._forget()

    def _forget(self) -> None:
        self.numbers = PieceNumbers()
        self.known = np.zeros((0, len(self.model.langs) + 1))

    def _score_pending(self) -> None:
        if not self.numbers.pending:
            return
        distinct: dict[str, int] = {}
        piece_of, word_of = [], []
        for k, piece in enumerate(self.numbers.pending):
            for word in words_of(piece):
                if word:
                    piece_of.append(k)
                    word_of.append(distinct.setdefault(word, len(distinct)))
        logs = np.zeros((len(distinct), len(self.model.langs)))
        for at, part in by_size(list(distinct)):
            if fits(len(part[0]), self.least):
                logs[at] = np.log(forward(self.lattice.find(part), self.model.chances)[-1])
            elif self.model.langs:
                logs[at] = [forward_log(self.lattice, x, self.logs) for x in part]
        fresh = np.zeros((len(self.numbers.pending), self.known.shape[1]))
        np.add.at(fresh, piece_of, np.column_stack([logs, np.ones(len(logs))])[word_of] if word_of else 0)
        self.known = np.concatenate([self.known, fresh])
        self.numbers.pending.clear()

    def totals(self, texts: Iterator[str]) -> np.ndarray:
        """A row for each text: log-probability by language, then the number of words."""
        out = []
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            self._score_pending()
            for row, numbers in held:
                out[row] += self.known[numbers].sum(axis=0)
            held.clear()
            if self.numbers.forget_at(REMEMBERED):
                self._forget()

        for row, text in enumerate(texts):
            out.append(np.zeros(self.known.shape[1]))
            for part in segments(text, SEGMENT_CHARS, _ANY_WHITE):
                pieces = part.split(" ")
                held.append((row, np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))))
                if len(self.numbers.pending) > 50_000:
                    settle()
        settle()
        return np.array(out).reshape(-1, self.known.shape[1])

    def predict(self, texts: Iterator[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for row in self.totals(texts):
            if not row[-1] or not self.model.langs:
                langs.append(UNKNOWN_LANG)
                scores.append(0.0)
            else:
                best = int(np.argmax(row[:-1]))
                langs.append(self.model.langs[best])
                scores.append(float(1 / np.exp(row[:-1] - row[best]).sum()))
        return langs, scores


def held_out(key):
    """Whether a key belongs to the third of documents that nothing is learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 1000, words_per_lang: int = 20_000, letters_per_word: int = 256) -> SegmentModel:
    """Fit on a sample bounded by docs_per_lang, words_per_lang and letters_per_word, of rows outside the held-out third."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(False)))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    # Ranked by hash within 64 shares of a language first: one language may have almost all rows.
    chosen = labelled.select("lang", "key", F.xxhash64("key").alias("h")).withColumn("share", F.pmod("h", F.lit(64)))
    for keys in (["lang", "share"], ["lang"]):
        first = Window.partitionBy(*keys).orderBy("h", "key")
        chosen = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_lang)
    chosen = stage(chosen.select("lang", "key").distinct(), "lang-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for k, x in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found.setdefault(k, Counter()).update(w for w in words_of(x) if 0 < len(w) <= letters_per_word)
            rows = [(k, w, n) for k, own in found.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    words = labelled.join(chosen, ["lang", "key"], "left_semi").select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts: dict[str, dict[str, int]] = {}
    for row in words.withColumn("place", F.row_number().over(most)).where(F.col("place") <= words_per_lang).select("lang", "word", "n").collect():
        counts.setdefault(row.lang, {})[row.word] = row.n
    return SegmentModel.fit(letter_pieces(vocabulary), counts)


def predict(docs: DataFrame, model: SegmentModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        own = Scorer(model)
        for batch in batches:
            langs, scores = own.predict(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: SegmentModel, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """docs without those whose language is `und` or scored below least_score; all columns unchanged."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        own = Scorer(model)
        for batch in batches:
            langs, scores = own.predict(texts_of(batch.column(at)))
            yield batch.filter(pa.array([x != UNKNOWN_LANG and s >= least_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))
        own = batch = None
        keep_nothing()

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, vocab.path("piece_bpe_32k.model")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
