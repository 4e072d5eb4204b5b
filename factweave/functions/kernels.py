"""Byte kernels that built-in functions cannot express, as Arrow-batched functions."""

from __future__ import annotations

import gzip
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MOST_BYTES, MOST_XOR_BYTES, MOST_DEPTH, MOST_STATES = 1 << 20, 16 << 10, 3, 12
LEAST_TEXT, LEAST_XOR = 10, 24
#: FNV-1a 64, and the two multipliers and shifts that scramble a number.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SCRAMBLE, SCRAMBLE_2, SHIFT, SHIFT_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 29, 32
_ALL = (1 << 64) - 1


def fnv1a(data: bytes, state: int = FNV_START) -> int:
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & _ALL
    return state


def fnv1a_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of many byte strings: one step for each place, over all strings that are long enough."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(values), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    state = np.full(len(values), FNV_START, np.uint64)
    still = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for place, n in enumerate(still.tolist()):  # the n longest have this place
        state[:n] = (state[:n] ^ flat[starts[:n] + place]) * np.uint64(FNV_PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


def scramble(x: int) -> int:
    x = x * SCRAMBLE & _ALL
    x = (x ^ (x >> SHIFT)) * SCRAMBLE_2 & _ALL
    return x ^ (x >> SHIFT_2)


def fold_numbers(hashes: np.ndarray) -> int:
    """One number for a multiset of 64-bit numbers: order does not count, multiplicity does."""
    return fnv1a(np.sort(hashes).astype("<u8").tobytes()) ^ scramble(len(hashes))


def fold_hashed(values: list[bytes]) -> int:
    return fold_numbers(fnv1a_many(values))


def _hashed(x: pd.Series) -> pd.Series:
    known = x.notna().to_numpy()
    out = pd.Series([None] * len(x), index=x.index, dtype=object)
    out[known] = fnv1a_many([bytes(v) for v in x[known]]).tolist()
    return out


@pandas_udf(T.DecimalType(20, 0))
def fnv1a_64(x: pd.Series) -> pd.Series:
    """FNV-1a of bytes as an unsigned number."""
    from decimal import Decimal

    return _hashed(x).map(lambda v: None if v is None else Decimal(v))


@pandas_udf(T.DecimalType(20, 0))
def fold_64(x: pd.Series) -> pd.Series:
    """The fold of an array of texts: each hashed, sorted, hashed together, and mixed with their number."""
    from decimal import Decimal

    return x.map(lambda v: None if v is None else Decimal(fold_hashed([t.encode() for t in v])))


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Unsigned LEB128: value and the place behind it."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return value, at


def read_signed_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return (value - (1 << shift) if b & 0x40 else value), at


@pandas_udf(T.ArrayType(T.LongType()))
def varints(x: pd.Series) -> pd.Series:
    """All unsigned LEB128 numbers of the bytes, or null if the last one is cut."""

    def decode(data):
        if data is None:
            return None
        out, at, data = [], 0, bytes(data)
        try:
            while at < len(data):
                value, at = read_varint(data, at)
                out.append(value)
        except IndexError:
            return None
        return out

    return x.map(decode)


def _little_endian(data: bytes, at: int, bits: int, bias: int, most_shift: int) -> tuple[int, int]:
    """Seven bits a byte, the lowest first; the last byte is the one above 127 and carries `bias`. Value and the place behind it."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        if b > 0x7F:
            return (value + ((b - bias) << shift)) & ((1 << bits) - 1), at
        value |= b << shift
        shift += 7
        if shift > most_shift:
            raise ValueError(f"number exceeds {bits} bits")


def _as_signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def read_unsigned(data: bytes, at: int = 0) -> tuple[int, int]:
    """Unsigned number of a snapshot stream, at most 63 bits and one byte."""
    value, at = _little_endian(data, at, 64, 128, 62)
    return _as_signed(value, 64), at


def read_tagged32(data: bytes, at: int = 0) -> tuple[int, int]:
    """32 bits whose last byte is biased by 192, so small negative numbers are short; as an unsigned number."""
    return _little_endian(data, at, 32, 192, 27)


def read_tagged64(data: bytes, at: int = 0) -> tuple[int, int]:
    value, at = _little_endian(data, at, 64, 192, 62)
    return _as_signed(value, 64), at


def read_reference(data: bytes, at: int = 0) -> tuple[int, int]:
    """Up to five bytes, the highest seven bits first; the last one has its top bit set."""
    value = 0
    for k in range(5):
        b = data[at + k]
        value = (value << 7) + _as_signed(b, 8)
        if b & 0x80:
            return value + 128, at + k + 1
    raise ValueError("reference exceeds five bytes")


def numbers_of(reader):
    """A function of a binary column that reads numbers to its end; null where the last one is cut or too large."""

    @pandas_udf(T.ArrayType(T.LongType()))
    def read(x: pd.Series) -> pd.Series:
        def decode(data):
            out, at = [], 0
            try:
                while at < len(data):
                    value, at = reader(data, at)
                    out.append(value)
            except (IndexError, ValueError):
                return None
            return out

        return x.map(lambda v: None if v is None else decode(bytes(v)))

    return read


def _text_parts():
    import regex

    from . import text

    ranges = regex.sub(r"\\x\{(\w+)\}", lambda m: regex.escape(chr(int(m[1], 16)), special_only=False, literal_spaces=False), text.TEXT_RANGES)
    path = regex.compile(r"[A-Za-z0-9/\\._:?&=%#-]+")
    return regex.compile(f"[{ranges}]+"), path, text.TEXT_MARKERS, regex.compile(r"\p{Alphabetic}"), regex.compile(r"\p{White_Space}"), regex.compile(r"[^\n\r\t\P{Cc}]")


def is_structured(value: str) -> bool:
    path = "/" in value and bool(_text()[1].fullmatch(value)) and (value[0] == "/" or "./" in value or any("." in s and len(s) > 2 for s in value.split("/")))
    return "://" in value or (value[:1], value[-1:]) in (("{", "}"), ("[", "]")) or path or ("@" in value and "." in value)


_TEXT: list = []


def _text() -> tuple:
    if not _TEXT:
        _TEXT.append(_text_parts())
    return _TEXT[0]


def score(value: str) -> int | None:
    """The text score of one text, the same as text.text_score gives for a column."""
    common, _, markers, alphabetic, white, control = _text()
    n = len(value)
    if not 4 <= n <= MOST_BYTES or not common.fullmatch(value) or control.search(value):
        return None
    letters, digits, spaces = len(alphabetic.findall(value)), sum("0" <= c <= "9" for c in value), len(white.findall(value))
    distinct, structured, wordy = len(set(value)), is_structured(value), 2 * letters >= n
    if letters < 4 or distinct < 3 or n > 15 and 8 * distinct < n or not (spaces or structured or n > 4 and wordy):
        return None
    marked = any(m in value.lower() for m in markers)
    return min(letters, 20) + min(digits, 5) + 2 * min(spaces, 8) + 2 * (n > 7) + 5 * wordy + 18 * structured + 10 * marked


def is_text(value: str) -> bool:
    return (score(value) or 0) >= LEAST_TEXT


def inflate(data: bytes) -> bytes | None:
    """All of one gzip or zlib stream, if that is at most MOST_BYTES."""
    stream = zlib.decompressobj(31 if data[:2] == b"\x1f\x8b" else 15)
    try:
        out = stream.decompress(data, MOST_BYTES + 1)
    except zlib.error:
        return None
    return out if len(out) <= MOST_BYTES and stream.eof else None


def best_xor(data: bytes) -> tuple[int, str] | None:
    """The single-byte key, the first of the best, that turns the bytes into telling text, and the text."""
    if not 8 <= len(data) <= MOST_XOR_BYTES:
        return None
    raw = np.frombuffer(data, np.uint8)
    present = np.flatnonzero(np.bincount(raw, minlength=256)).astype(np.uint8)
    best: tuple[int, int, str] | None = None
    for key in range(1, 256):
        seen = present ^ np.uint8(key)
        if ((seen < 32) & (seen != 9) & (seen != 10) & (seen != 13) | (seen == 127)).any():
            continue  # control characters are no text
        try:
            own = (raw ^ np.uint8(key)).tobytes().decode()
        except UnicodeDecodeError:
            continue
        points = score(own) or 0
        telling = any(c.isspace() for c in own) or is_structured(own) or any(m in own.lower() for m in _text()[2])
        if points >= LEAST_XOR and telling and (best is None or points > best[0]):
            best = points, key, own
    return best and best[1:]


def utf16_text(data: bytes) -> tuple[str, str] | None:
    """Text of 16-bit units that a mark or zero bytes give away, and its byte order."""
    if len(data) < 8 or len(data) % 2:
        return None
    half, mark = len(data) // 2, data[:2]
    if mark == b"\xff\xfe" or 4 * data[1::2].count(0) >= half:
        order = "utf16le"
    elif mark == b"\xfe\xff" or 4 * data[::2].count(0) >= half:
        order = "utf16be"
    else:
        return None
    try:
        value = data[2 * (mark in (b"\xff\xfe", b"\xfe\xff")) :].decode("utf-16-le" if order == "utf16le" else "utf-16-be")
    except UnicodeDecodeError:
        return None
    return (value, order) if is_text(value) else None


#: Letters of base64, standard and for addresses.
_BASE64 = {c: k for k, c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {ord("-"): 62, ord("_"): 63}


def from_base64(data: bytes) -> bytes | None:
    """Bytes of base64 that shows itself and leaves no bits over, see text.base64_decode."""
    import base64

    body = data.rstrip(b"=")
    padding, rest = len(data) - len(body), len(body) % 4
    if not 8 <= len(data) <= MOST_BYTES or padding > 2 or any(c not in _BASE64 for c in body) or rest == 1 or padding and len(data) % 4:
        return None
    if not padding and not any(48 <= c < 58 or c in b"+/" for c in body):
        return None
    if rest and _BASE64[body[-1]] & ((1 << (2 * (4 - rest))) - 1):
        return None
    return base64.b64decode(body.translate(bytes.maketrans(b"-_", b"+/")) + b"=" * (-rest % 4)) or None


def _steps(data: bytes) -> list[tuple[str, bytes]]:
    """What can be undone: hexadecimal digits, base64, and one of gzip and zlib."""
    found: list[tuple[str, bytes | None]] = []
    if len(data) >= 8 and not len(data) % 2 and all(c in b"0123456789abcdefABCDEF" for c in data):
        found.append(("hex", bytes.fromhex(data.decode())))
    found.append(("base64", from_base64(data)))
    if data[:2] == b"\x1f\x8b":
        found.append(("gzip", inflate(data)))
    elif len(data) > 1 and data[0] & 15 == 8 and not (256 * data[0] + data[1]) % 31:
        found.append(("zlib", inflate(data)))
    return [(name, out) for name, out in found if out and len(out) <= MOST_BYTES]


def recover(data: bytes, typed: bool = False) -> list[tuple[str, str, str]]:
    """(text, path of transforms, confidence) by a search in breadth: at most MOST_DEPTH transforms and MOST_STATES states.

    typed: the bytes are data, which may be text as they stand, else they are the bytes of a text that is known already.
    A key is only tried where nothing reads as text, and behind at most one transform.
    """
    if not 4 <= len(data) <= MOST_BYTES:
        return []
    out: list[tuple[str, str, str]] = []
    seen, queue, states = {data}, deque([(data, [])]), 0
    while queue and states < MOST_STATES:
        own, path = queue.popleft()
        states += 1
        if typed or path:
            direct = []
            try:
                if is_text(value := own.decode()):
                    direct.append((value, "utf8"))
            except UnicodeDecodeError:
                pass
            direct += filter(None, [utf16_text(own)])
            out += [(value, " -> ".join([*path, name]), "high") for value, name in direct]
            if not direct and len(path) < 2 and (hit := best_xor(own)):
                out.append((hit[1], " -> ".join([*path, f"xor(key=0x{hit[0]:02x})", "utf8"]), "medium"))
        if len(path) < MOST_DEPTH:
            for name, result in _steps(own):
                if result not in seen:
                    seen.add(result)
                    queue.append((result, [*path, name]))
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "path", "confidence")]))


def _transducer(typed: bool):
    @pandas_udf(_FOUND)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else [{"text": t, "path": p, "confidence": c} for t, p, c in recover(bytes(v), typed)])

    return run


#: Texts hidden in the bytes of known texts, and in typed data.
transduce, transduce_typed = _transducer(False), _transducer(True)


def pack_gzip(text: str) -> bytes:
    return gzip.compress(text.encode(), mtime=0)


@pandas_udf(T.DoubleType())
def double_from_bits(x: pd.Series) -> pd.Series:
    """The double whose bits a signed 64-bit number holds."""
    known = x.notna()
    out = pd.Series(np.nan, index=x.index, dtype=object)
    out[known] = x[known].astype("int64").to_numpy().view(np.float64)
    return out.where(known, None)
