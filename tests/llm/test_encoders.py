"""Token counts, byte-level BPE and token files against the libraries."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from factweave.llm import bpe, token_counts, token_files, vocab

os.environ["TOKENIZERS_PARALLELISM"] = "false"
LETTERS = [*"abcde'st  \n\t.,!?01239ÀéßÑ’“”中😀\x00\x1c\x1f\x85\xa0​ 　▁<|>ſḰİΣσ", "́", "é", " the", " and", "<|endoftext|>", "<|startoftext|>", "  ", "n't", "'re", " 've", "▁▁", "\r\n", "LL'LL", "don't"]


def texts(seed=1, n=3000):
    random.seed(seed)
    yield from ("", " ", "▁", "\n", "a " * 50, "word")
    for _ in range(n):
        yield "".join(random.choices(LETTERS, k=random.randint(0, 30)))


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBpe(vocab.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(vocab.path(name))


def test_byte_bpe_matches_library(byte_bpe, library):
    own = library("byte_bpe_50k.json")
    for x in texts():
        ids = own.encode(x, add_special_tokens=False).ids
        assert byte_bpe.encode(x).tolist() == ids, x
        assert byte_bpe.decode(byte_bpe.encode(x)) == own.decode(ids, skip_special_tokens=False) == x


def test_every_token_encodes_to_itself(byte_bpe):
    assert all(byte_bpe.table.encode(x) == [n] for n, x in enumerate(byte_bpe.table.text))


def test_backtracking_matches_plain_merging(byte_bpe):
    table = byte_bpe.table

    def plain(piece):
        parts = list(piece)
        while True:
            rank, at = min(((table.joined.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if rank == 1 << 60:
                return parts
            parts[at : at + 2] = [rank]

    random.seed(2)
    for _ in range(3000):
        piece = bytes(random.choices(b"abcdeinghtsraou \xc3\xa9-.", k=random.randint(1, 40)))
        assert table.encode(piece) == plain(piece)


def test_decoding_cut_characters_replaces_bytes(byte_bpe):
    ids = byte_bpe.encode("😀")
    assert byte_bpe.decode(ids[:1]) == ids[:1].size * "�"


def test_piece_counts_match_library():
    import sentencepiece

    own, model = token_counts.counter(vocab.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))
    cases = list(texts(3))
    assert own.counts(iter(cases)) == [len(x) for x in model.encode(cases)]


def test_piece_counts_do_not_depend_on_memory_or_segments(monkeypatch):
    cases = list(texts(4, 300)) + ["some words with spaces " * 40]
    path = vocab.path("piece_bpe_32k.model")
    whole = token_counts.counter(path).counts(iter(cases))
    monkeypatch.setattr(token_counts, "SEGMENT_CHARS", 7)
    small = token_counts.PieceModelCounter(path, remembered=5)
    assert [small.counts(iter([x]))[0] for x in cases] == whole


def test_word_bpe_matches_library(library, monkeypatch):
    own, ids = library("word_bpe_49k.json"), token_files.WordBpe(vocab.path("word_bpe_49k.json"))
    cases = list(texts(5)) + ["Plain words, with marks... And Ünïcode Äpfel!", "a.b,c;d:e!f?g", "ABC.Def"]
    for x in cases:
        assert ids.encode(x).tolist() == own.encode(x, add_special_tokens=False).ids, x
    monkeypatch.setattr(token_files, "SEGMENT_CHARS", 5)
    small = token_files.WordBpe(vocab.path("word_bpe_49k.json"), remembered=3)
    for x in cases[:400]:
        assert small.encode(x).tolist() == ids.encode(x).tolist()


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_op7(table, request, library):
    import sentencepiece

    docs, model = request.getfixturevalue(table), sentencepiece.SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts.token_counts(docs, vocab.path("piece_bpe_32k.model")).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_op4(table, request, library):
    docs, own = request.getfixturevalue(table), library("byte_bpe_50k.json")
    got = sorted(map(tuple, bpe.bpe_digests(docs, vocab.path("byte_bpe_50k.json")).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_documents_keeps_columns(odd_docs):
    out = bpe.encode_documents(odd_docs, vocab.path("byte_bpe_50k.json"))
    assert out.columns == [*odd_docs.columns, "token_ids", "decoded"]
    assert all((r.text or "") == r.decoded for r in out.collect())


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_op2(table, request, library, spark, tmp_path):
    docs, own = request.getfixturevalue(table), library("word_bpe_49k.json")
    folder = f"file:{tmp_path}/tokens"
    manifest = token_files.write_token_files(docs, folder, vocab.path("word_bpe_49k.json"), files=3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_digests(spark, manifest, folder).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert [r[2] for r in got] == [sum(x[3] for x in got[:k]) for k in range(len(got))]
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r[0], r[1], r[3], r[4]) for r in got) == sorted(want)


def test_sequences_and_masks(tmp_path):
    import pyarrow as pa

    writer = token_files.SequenceWriter(str(tmp_path), "part.arrows", np.uint16, pa.int64(), sequence=8, batch_rows=2)
    stream = np.arange(3, 40, dtype=np.uint16)
    writer.add(7, iter([stream[:20], stream[20:]]), 2)
    writer.close()
    file = token_files.SequenceFile(f"{tmp_path}/part.arrows")
    ids, mask = file.sequence_at(0)
    assert ids.tolist() == list(range(3, 11)) and all(mask.to_pylist())
    ids, mask = file.sequence_at(4)
    assert ids.tolist() == [35, 36, 37, 38, 39, 2, 0, 0] and mask.to_pylist() == [True] * 6 + [False] * 2
    assert np.concatenate(list(file.tokens(14, 20))).tolist() == stream[14:34].tolist()
    assert not file.sequence_at(1)[0].flags.owndata  # a view of the mapped file


def seconds(function, *args):
    import time

    began = time.perf_counter()
    function(*args)
    return time.perf_counter() - began


def test_byte_bpe_time_is_linear_in_one_unit(byte_bpe, library):
    rng = random.Random(9)
    unit = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    half = seconds(byte_bpe.encode, unit[: 1 << 19])
    assert seconds(byte_bpe.encode, unit) < 4 * half + 1
    own = library("byte_bpe_50k.json")
    for x in (unit[:300_000], "ab" * 100_000, " " * 100_000, "的是不了" * 30_000, "=" * 50_000):
        assert byte_bpe.encode(x).tolist() == own.encode(x, add_special_tokens=False).ids


def test_byte_bpe_remembers_a_bounded_number(library):
    rng = random.Random(10)
    small, own = bpe.ByteBpe(vocab.path("byte_bpe_50k.json"), remembered=500), library("byte_bpe_50k.json")
    for k in range(3000):
        x = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6)) + "。" + "".join(rng.choices("abc", k=3))
        ids = small.encode(x).tolist()
        if not k % 50:
            assert ids == own.encode(x, add_special_tokens=False).ids
        assert len(small.units) <= 510 and small.numbers.count <= 510
    small.encode("".join(rng.choices("abcdefgh", k=100_000)))
    assert all(len(x) <= bpe.LONG_UNIT for x in small.units)


def test_op4_megabytes_in_one_unit(spark, library):
    text = "".join(random.Random(11).choices("ABCDEFGHabcdefgh0123456789+/", k=1_500_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = bpe.bpe_digests(docs, vocab.path("byte_bpe_50k.json")).first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.n_tokens == len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)


def test_batches_of_a_remote_file_are_read_by_offset(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyarrow import fs

    monkeypatch.setattr(token_files, "INDEX_ROWS", 3)
    writer = token_files.SequenceWriter(str(tmp_path), "part.arrows", np.uint32, pa.int64(), sequence=8, batch_rows=2)
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 60_000, n).astype(np.uint32) for n in (0, 5, 100, 1, 40, 16, 7, 333)]
    for k, x in enumerate(parts):
        writer.add(k, iter([x]), 2)
    writer.close()
    read = []

    class Source:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read_buffer(self, size):
            read.append(size)
            return self.file.read_buffer(size)

    far = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    monkeypatch.setattr(token_files, "file_system", lambda uri: (far, uri.lstrip("/")))
    file = token_files.SequenceFile(f"{tmp_path}/part.arrows")
    file.source = Source(file.source)
    found = [(k, s, n) for batch in file.index() for k, s, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
    assert [k for k, _, _ in found] == list(range(8)) and sum(b.num_rows for b in file.index()) == 8 and len(list(file.index())) == 3
    for k, start, size in reversed(found):
        assert np.concatenate(list(file.tokens(start, size))).tolist() == [*parts[k].tolist(), 2]
    read.clear()
    file.sequence_at(40)
    assert len(read) == 1 and read[0] <= file.step < file.size / 10


def test_a_task_that_runs_again_leaves_the_same_files(tmp_path):
    import os

    import pyarrow as pa

    def write():
        writer = token_files.SequenceWriter(str(tmp_path), "part-0000000.arrows", np.uint16, pa.int64(), sequence=8, batch_rows=2)
        writer.add(7, iter([np.arange(30, dtype=np.uint16)]), 2)
        return writer

    first, second, lost = write(), write(), write()
    first.close()
    second.close()
    third = write()
    third.discard()
    lost.sinks[0].close()
    lost.sinks[1].close()
    assert len(os.listdir(tmp_path)) == 4
    token_files.delete_leftovers(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["part-0000000.arrows", "part-0000000.arrows.index"]
    assert np.concatenate(list(token_files.SequenceFile(f"{tmp_path}/part-0000000.arrows").tokens(0, 31))).tolist() == [*range(30), 2]


def test_files_follow_the_bytes_of_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('ab ', 20) AS text")
    manifest = token_files.write_token_files(docs, f"file:{tmp_path}/t", vocab.path("word_bpe_49k.json"))
    assert manifest.count() == 12 and manifest.agg({"n_docs": "sum"}).first()[0] == 200
