"""Token-ID files: Arrow stream files of fixed-size lists.

All ids, each document followed by an end id, lie in ascending key order in files of equal-length sequences. A file is an
Arrow IPC stream of batches with equally many rows; a row holds `ids`, a fixed-size list of unsigned integers just wide
enough for the vocabulary, and `mask`, a fixed-size list of booleans that are true where an id is real. Only a file's last
sequence is padded. Mapped into memory, any sequence or token range is a slice of a batch's buffers: batch and row follow
from division. In a remote store, all full batches take equally many bytes, so a batch's offset follows too and only that
range is read. A second stream file beside it holds key, start and length of each document in the file, in batches.

Rows are dealt to files by ranges of the key, about `FILE_BYTES` of text each, so a file's place in the global order is its
number, and the starts of files follow from one count for each file. Each task writes under a name of its own and then
renames; a task that is run again or twice at once finds the target there and leaves it, as both would be the same. What a
failed task wrote under its own name is deleted, by itself or at the end. Files go through pyarrow's file systems to the
shared folder.

Defined cases: a null or empty text is just the end id; a null key comes first; rows with one key follow each other by
their texts' hash, and rows equal in both are the same wherever they stand; an empty table makes no file and gives an
empty result; other columns are ignored. A long text passes the encoder in segments, and its ids are written as they come.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .chunks import PieceNumbers, RaggedPool, byte_groups, kept, texts_of
from .staging import fresh_path, stage
from .token_counts import segments

SEQUENCE, BATCH_ROWS = 2048, 64
#: Bytes of text that a file is made of, about; where that leaves cores without work, as little as the second number.
FILE_BYTES, LEAST_FILE_BYTES = 128 << 20, 4 << 20
#: Documents in one batch of an index.
INDEX_ROWS = 1 << 16
REMEMBERED = 500_000
#: Bytes of text whose new pieces are encoded at once.
GROUP_BYTES = 4 << 20
SEGMENT_CHARS = 1 << 20
_CUT = re.compile("(?<=[^ ]) (?=[^ ])")

#: Text whose characters each have one normal form and one lower case, whatever stands beside them, and no two marks in a row.
_MARKS = ".,!?;:"
_SIMPLE = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ{_MARKS} \n]*")
_MARK_RUN = re.compile(f"[{_MARKS}]{{2}}")
_UNIT = re.compile(f"[a-zß-öø-ÿ]+|[{_MARKS}]+")


def pieces_of(text: str) -> list[str]:
    """Pieces that the tokenizer of a file with word ends takes one by one.

    White space is a safe boundary: nothing there crosses it. Simple text is cut further into lower-case words and marks,
    the same units that the file's own rules cut, so that fewer distinct ones reach the library.
    """
    if _SIMPLE.fullmatch(text) and not _MARK_RUN.search(text):
        low = text.lower()
        for mark in _MARKS:
            if mark in low:
                low = low.replace(mark, f" {mark} ")
        return low.split()
    lines = text.split("\n")
    return [x for line in lines for x in pieces_of(line)] if len(lines) > 1 else text.split(" ")


class WordBpe:
    """Ids of the tokenizers library for a file that drops white space and marks word ends."""

    def __init__(self, model_path: str, remembered: int = REMEMBERED) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model_path)
        self.model.no_truncation()
        self.model.no_padding()
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        for token, number in self.model.get_vocab(with_added_tokens=True).items():
            self.ends[number] = token.endswith("</w>")
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.pool = PieceNumbers(), RaggedPool(self.dtype)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), self.dtype, int(sizes.sum())), sizes

    def _encode_pending(self) -> None:
        waiting = self.numbers.pending
        for first in range(0, len(waiting), 2048):
            part = waiting[first : first + 2048]
            plain = np.array([_UNIT.fullmatch(x) is not None for x in part])
            units = [x for x, p in zip(part, plain, strict=True) if p]
            flat = np.array(self.model.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.ends[flat]) + 1  # every unit is one word to the file and ends in one end token
            if len(stops) != len(units):
                plain[:] = False
                flat, stops = flat[:0], stops[:0]
            sizes = np.zeros(len(part), np.int64)
            sizes[plain] = np.diff(stops, prepend=0)
            if not plain.all():
                odd, sizes[~plain] = self._library([x for x, p in zip(part, plain, strict=True) if not p])
                both, is_plain = np.zeros(int(sizes.sum()), self.dtype), np.repeat(plain, sizes)
                both[is_plain], both[~is_plain] = flat, odd
                flat = both
            self.pool.extend(flat, sizes)
        waiting.clear()

    def _look(self, text: str) -> np.ndarray:
        pieces = pieces_of(text)
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids, a segment at a time."""
        for part in segments(text, SEGMENT_CHARS, _CUT):
            numbers = self._look(part)
            self._encode_pending()
            yield self.pool.take(numbers)
            if self.numbers.forget_at(self.remembered):
                self._forget()

    def encode_group(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """For each text its ids in parts; what is new in texts of ordinary size is encoded in one call."""
        held = [self._look(text) if len(text) <= SEGMENT_CHARS else None for text in texts]
        self._encode_pending()
        ready = [None if numbers is None else self.pool.take(numbers) for numbers in held]
        if self.numbers.forget_at(self.remembered):
            self._forget()
        for text, ids in zip(texts, ready, strict=True):
            yield self.encode_parts(text) if ids is None else iter([ids])

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.dtype), *self.encode_parts(text)])


def file_system(uri: str):
    """pyarrow's file system and path for a Hadoop-style URI or a local path."""
    from pyarrow import fs

    if ":" not in uri.split("/", 1)[0]:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes one stream file of equal-length sequences, and its index of documents."""

    def __init__(self, folder: str, name: str, dtype: type, key_type: pa.DataType, sequence: int = SEQUENCE, batch_rows: int = BATCH_ROWS) -> None:
        self.fs, self.folder = file_system(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.final = f"{self.folder}/{name}"
        self.own = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, sequence), False), pa.field("mask", pa.list_(pa.bool_(), sequence), False)])
        self.index_schema = pa.schema([pa.field("key", key_type), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(self.own), self.fs.open_output_stream(self.own + ".index")]
        self.stream, self.index_stream = (pa.ipc.new_stream(sink, schema) for sink, schema in zip(self.sinks, (self.schema, self.index_schema), strict=True))
        self.sequence, self.room = sequence, np.zeros(sequence * batch_rows, dtype)
        self.filled = self.total = self.docs = 0
        self.index: list[tuple] = []

    def add(self, key, parts: Iterator[np.ndarray], end_id: int) -> None:
        start = self.total
        for part in parts:
            self._put(part)
        self._put(np.array([end_id], self.room.dtype))
        self.docs += 1
        self.index.append((key, start, self.total - start))
        if len(self.index) == INDEX_ROWS:
            self._flush_index()

    def _put(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            step = min(len(ids), len(self.room) - self.filled)
            self.room[self.filled : self.filled + step] = ids[:step]
            self.filled += step
            ids = ids[step:]
            if self.filled == len(self.room):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.filled // self.sequence)
        if rows:
            held = self.room[: rows * self.sequence].copy()
            held[self.filled :] = 0
            mask = np.arange(len(held)) < self.filled
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (held, mask)]
            self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            self.filled = 0

    def _flush_index(self) -> None:
        if self.index:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.index, strict=True), self.index_schema, strict=True)]
            self.index_stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index_schema))
            self.index.clear()

    def close(self) -> None:
        self._flush()
        self._flush_index()
        for stream, sink in zip((self.stream, self.index_stream), self.sinks, strict=True):
            stream.close()
            sink.close()
        for end in (".index", ""):
            self._settle(self.own + end, self.final + end)

    def _settle(self, own: str, final: str) -> None:
        """Gives a file its final name, unless another attempt at the task has been there first."""
        from pyarrow import fs

        there = lambda: self.fs.get_file_info(final).type == fs.FileType.File
        if not there():
            try:
                self.fs.move(own, final)
                return
            except OSError:
                if not there():
                    raise
        self.fs.delete_file(own)

    def discard(self) -> None:
        """Takes away what a failed task has written under its own name."""
        from pyarrow import fs

        for sink in self.sinks:
            sink.close()
        for path in (self.own, self.own + ".index"):
            if self.fs.get_file_info(path).type == fs.FileType.File:
                self.fs.delete_file(path)


def delete_leftovers(folder: str) -> None:
    """Deletes what tasks left under names of their own when their executors were lost. For the end of the writing."""
    from pyarrow import fs

    system, path = file_system(folder)
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.startswith(".") and ".arrows." in info.base_name and not info.base_name.endswith(".crc"):
            system.delete_file(info.path)


class SequenceFile:
    """A stream file opened for random access: a local one is mapped and its buffers are not copied, of a remote one only batches asked for are read."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.system, self.path = file_system(uri)
        local = isinstance(self.system, fs.LocalFileSystem)
        self.source = pa.memory_map(self.path) if local else self.system.open_input_file(self.path)
        stream = pa.ipc.open_stream(self.source)
        self.schema, self.begin = stream.schema, self.source.tell()
        first = stream.read_next_batch()
        self.step = self.source.tell() - self.begin  # all batches but the last take as much
        self.sequence, self.batch_rows = self.schema.field("ids").type.list_size, first.num_rows
        self.size = self.source.size()
        self.last: tuple[int, pa.RecordBatch] = (0, first)

    def batch(self, number: int) -> pa.RecordBatch:
        if self.last[0] != number:
            place = self.begin + number * self.step
            self.source.seek(place)
            message = pa.ipc.read_message(self.source.read_buffer(min(self.step, self.size - place)))
            self.last = number, pa.ipc.read_record_batch(message, self.schema)
        return self.last[1]

    def index(self) -> Iterator[pa.RecordBatch]:
        """Key, start and n_tokens of the documents, batch by batch."""
        with self.system.open_input_stream(self.path + ".index") as file:
            yield from pa.ipc.open_stream(file)

    def _flat(self, number: int) -> np.ndarray:
        return self.batch(number).column(0).values.to_numpy(zero_copy_only=True)

    def sequence_at(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """ids and mask of one sequence."""
        number, within = divmod(row, self.batch_rows)
        ids = self._flat(number)[within * self.sequence : (within + 1) * self.sequence]
        return ids, self.batch(number).column(1).values.slice(within * self.sequence, self.sequence)

    def tokens(self, start: int, size: int) -> Iterator[np.ndarray]:
        """The ids from start on, one slice of each batch that holds some."""
        per_batch = self.batch_rows * self.sequence
        while size:
            number, within = divmod(start, per_batch)
            step = min(size, per_batch - within)
            yield self._flat(number)[within : within + step]
            start, size = start + step, size - step


def write_token_files(docs: DataFrame, folder: str, model_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Write the files and return file, first, n_tokens, n_docs of each; first counts the ids of all files before."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    if not files:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(-(-size // FILE_BYTES), min(4 * spark.sparkContext.defaultParallelism, -(-size // LEAST_FILE_BYTES)), 1)
    rows = rows.repartitionByRange(files, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, writer, own = f"part-{TaskContext.get().partitionId():07d}.arrows", None, None
        try:
            for batch in batches:
                if writer is None and batch.num_rows:
                    own = kept(("word bpe", model_path), lambda: WordBpe(model_path))
                    writer = SequenceWriter(folder, name, own.dtype, batch.schema.field(0).type)
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for first, last in byte_groups(sizes, GROUP_BYTES):
                    keys = batch.column(0).slice(first, last - first).to_pylist()
                    texts = list(texts_of(batch.column(1).slice(first, last - first)))
                    for k, parts in zip(keys, own.encode_group(texts), strict=True):
                        writer.add(k, parts, end_id)
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.discard()
            raise
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"file": [name], "n_tokens": [writer.total], "n_docs": [writer.docs]})

    manifest = stage(rows.mapInArrow(write, "file string, n_tokens bigint, n_docs bigint"), "token-files")
    delete_leftovers(folder)
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    return manifest.select("file", F.coalesce(before, F.lit(0)).alias("first"), "n_tokens", "n_docs")


def read_token_digests(spark: SparkSession, manifest: DataFrame, folder: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = SequenceFile(f"{folder}/{name}")
                for part in file.index():
                    sums = []
                    for start, size in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for ids in file.tokens(start, size):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([part.column("key"), pc.add(part.column("start"), first), part.column("n_tokens"), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    return manifest.select("file", "first").repartition(max(files, 1)).mapInArrow(read, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "tokens")
    manifest = write_token_files(docs, folder, vocab.path("word_bpe_49k.json"))
    return read_token_digests(spark, manifest, folder)
