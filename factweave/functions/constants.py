"""Source text of constant graphs: nodes that refer to each other, shown to a bounded depth and width."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from .text import RESERVED

MOST_DEPTH, MOST_ITEMS = 4, 24
#: A node: its number, kind, whole number, double, text (a string, a type, a function, a class), enum member, type arguments, references, keys of slots, and types of unboxed slots.
NODE = "node long, kind string, number long, real double, text string, member string, type_arguments string, refs array<long>, keys array<string>, slot_types array<string>"
COMPOSITE = {"list", "set", "map", "record", "instance"}
_SAFE_TYPE = re.compile(r"[A-Za-z0-9_$<>, ?.]+")


def quoted(text: str) -> str:
    """A literal in single quotes."""
    marks = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "$": "\\$"}
    hidden = lambda c: ord(c) < 32 or ord(c) == 0x7F or 0x202A <= ord(c) <= 0x202E or 0x2066 <= ord(c) <= 0x2069
    return "'" + "".join(marks.get(c) or (f"\\u{{{ord(c):x}}}" if hidden(c) else c) for c in text) + "'"


def identifier(text: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_$]", "_", text)
    return "_" + clean if not clean or clean[0].isdigit() or clean in RESERVED else clean


def symbol(text: str) -> str:
    return text.split("@")[0].strip("<>")


def double_text(value: float) -> str:
    if math.isnan(value):
        return "double.nan"
    if math.isinf(value):
        return "double.infinity" if value > 0 else "double.negativeInfinity"
    return repr(value)


def unboxed_text(bits: int, kind: str | None) -> str:
    """Bits of a slot: by its declared type, else a whole number if it is small, a double if it is plain, or the bits themselves."""
    kind = (kind or "").rstrip("?")
    real = struct.unpack("<d", struct.pack("<q", bits))[0]
    if kind == "double":
        return double_text(real)
    if kind == "int" or -(1 << 32) <= bits < 1 << 32:
        return str(bits)
    if math.isfinite(real) and 1e-9 <= abs(real) < 1e15 and len(text := double_text(real)) <= 12:
        return text
    return f"aot.unboxedBits(0x{bits % (1 << 64):x})"


def type_prefix(arguments: str | None, arity: int) -> str:
    """Type arguments in angle brackets if they are well-formed and as many as asked for, else nothing."""
    if arguments is None:
        return ""
    inner = arguments.strip()
    if inner.startswith("<") and inner.endswith(">"):
        inner = inner[1:-1].strip()
    depth, count = 0, 1
    for sign in inner:
        depth += (sign == "<") - (sign == ">")
        count += sign == "," and not depth
        if depth < 0:
            return ""
    return f"<{inner}>" if inner and not depth and count == arity and _SAFE_TYPE.fullmatch(inner) else ""


def type_text(shown: str) -> str:
    base = shown.rstrip("?")
    return base if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", base) and base not in RESERVED else f"aot.constType({quoted(shown)})"


def _joined(parts: list[str], total: int) -> str:
    return ", ".join(parts + ([f"/* {total - MOST_ITEMS} more */"] if total > MOST_ITEMS else []))


def render(nodes: dict[int, dict], root: int) -> str | None:
    """The text of a node; what is too deep, missing or within itself is a reference."""
    if root not in nodes:
        return None
    active: set[int] = set()

    def plain(n: dict) -> str | None:
        made: dict[str, Callable[[], str]] = {
            "null": lambda: "null", "bool": lambda: "true" if n["number"] else "false", "int": lambda: str(n["number"]), "double": lambda: double_text(n["real"]), "string": lambda: quoted(n["text"]),
            "type": lambda: type_text(n["text"]), "enum": lambda: f"{identifier(symbol(n['text']))}.{identifier(n['member'])}",
        }
        if n["kind"] == "closure" and n["text"] is not None:
            return f"aot.constClosure({quoted(n['text'])})"
        return made[n["kind"]]() if n["kind"] in made else None

    def show(at: int, depth: int) -> str:
        n = nodes.get(at)
        reference = f"aot.snapshotRef({at})"
        if n is None:
            return reference
        if n["kind"] not in COMPOSITE:
            return plain(n) or reference
        if depth >= MOST_DEPTH or at in active or n["kind"] == "record" and n["number"]:
            return reference
        active.add(at)
        refs, below = list(n["refs"] if n["refs"] is not None else []), depth + 1
        if n["kind"] == "map":
            entries = [f"{show(k, below)}: {show(v, below)}" for k, v in zip(refs[: 2 * MOST_ITEMS : 2], refs[1 : 2 * MOST_ITEMS : 2], strict=False)]
            prefix = type_prefix(n["type_arguments"], 2) or ("" if refs else "<dynamic, dynamic>")
            out = f"const {prefix}{{{_joined(entries, len(refs) // 2)}}}"
        elif n["kind"] == "instance":
            kinds = list(n["slot_types"] if n["slot_types"] is not None else []) or [None] * len(refs)
            slots = list(zip(n["keys"] if n["keys"] is not None else [], refs, kinds, strict=True))
            entries = [f"{quoted(k)}: {unboxed_text(r, t.removeprefix('unboxed').removeprefix(':')) if t and t.startswith('unboxed') else show(r, below)}" for k, r, t in slots[:MOST_ITEMS]]
            out = f"aot.constObject({quoted(symbol(n['text']))}, <String, Object?>{{{_joined(entries, len(slots))}}})"
        else:
            body = _joined([show(r, below) for r in refs[:MOST_ITEMS]], len(refs))
            prefix = type_prefix(n["type_arguments"], 1)
            out = {"list": f"const {prefix}[{body}]", "set": f"const {prefix}{{{body}}}", "record": f"({body},)" if len(refs) == 1 else f"({body})"}[n["kind"]]
        active.discard(at)
        return out

    return show(root, 0)


def render_constants(nodes: DataFrame, roots: DataFrame, graph: str) -> DataFrame:
    """graph, root, text. nodes: graph and the columns of NODE; roots: graph, root. A graph is one task; its parts are bounded by depth and width."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {int(r["node"]): {k: None if not hasattr(v, "__len__") and pd.isna(v) else v for k, v in r.items()} for r in left.to_dict("records")}
        for n in known.values():
            n["number"] = None if n["number"] is None else int(n["number"])
        out = [(g, int(r), render(known, int(r))) for g, r in zip(right[graph], right["root"], strict=True)]
        return pd.DataFrame(out, columns=[graph, "root", "text"])

    kind = dict(nodes.dtypes)[graph]
    return nodes.groupBy(graph).cogroup(roots.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, root long, text string")
