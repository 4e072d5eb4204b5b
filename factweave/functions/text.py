"""Text functions. Each takes and returns columns and stays within code generation, but for split_index, which reads backwards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_parse(x: Column | str) -> Column:
    """The number that hexadecimal digits stand for, with or without 0x; null for anything else."""
    digits = F.regexp_replace(_c(x), "^0[xX]", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, 10).cast("decimal(20,0)"))


def extract_uri(x: Column | str) -> Column:
    """The first package: or dart: address of a noisy text, up to the first .dart behind it; null if other signs stand between."""
    found = F.regexp_extract(_c(x), r"(?s)(?:package:|dart:).*?\.dart", 0)
    return F.when(found.rlike(r"^[A-Za-z0-9:/_.-]+\z"), found)


def package_of(uri: Column | str) -> Column:
    """The package of a package: address; null for others."""
    return F.when(_c(uri).startswith("package:"), F.split_part(F.substring(_c(uri), F.lit(9), F.length(_c(uri))), F.lit("/"), F.lit(1)))


def strip_key(name: Column | str) -> Column:
    """A name without its private key; the mark of the top level becomes empty."""
    return F.when(_c(name) == "::", "").otherwise(F.regexp_replace(_c(name), "@[0-9]+", ""))


def token_replace(x: Column | str, token: str, by: str) -> Column:
    """Replaces whole identifiers only."""
    return F.regexp_replace(_c(x), rf"(?<![A-Za-z0-9_])\Q{token}\E(?![A-Za-z0-9_])", by)


def token_map(x: Column | str, mapping: dict[str, str]) -> Column:
    """Maps the whole text if it has a mapping, else each identifier in it; what stands between identifiers is kept."""
    known = F.create_map(*[F.lit(y) for pair in mapping.items() for y in pair])
    parts = F.regexp_extract_all(_c(x), F.lit(r"[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+"), F.lit(0))
    return F.coalesce(known[_c(x)], F.array_join(F.transform(parts, lambda w: F.coalesce(known[w], w)), ""))


def canonical_type(x: Column | str) -> Column:
    """A type without white space and trailing question marks."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\s+", ""), r"\?+$", "")


def type_root(x: Column | str) -> Column:
    """What stands before type arguments or a question mark."""
    return F.regexp_extract(_c(x), r"^([^<?]*)", 1)


def sanitize_path(path: Column | str, extension: str = "dart") -> Column:
    """Clean relative segments, without dots for folders. The extension is added if the last segment has none at all."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: ~p.isin("", ".", ".."))
    joined = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "[^A-Za-z0-9_.-]", "_")), "/")
    bare = ~F.substring_index(joined, "/", -1).rlike(r"^.+\.") & (joined != "")
    return F.when(bare, F.concat(joined, F.lit("." + extension))).otherwise(joined)


def output_path(uri: Column | str, application: str | None = None) -> Column:
    """A library's file: the application's own at the top, other packages and the SDK in folders, all else under a digest."""
    u = _c(uri)
    rest = F.substring(u, F.lit(9), F.length(u))
    package, path = F.substring_index(rest, "/", 1), F.substring(rest, F.locate("/", rest) + 1, F.length(rest))
    folder = F.when(package == F.lit(application), "").when(package == "", "packages/").otherwise(F.concat(F.lit("packages/"), package, F.lit("/")))
    digest = F.concat(F.lit("recovered_"), F.substring(F.sha2(u.cast("binary"), 256), 1, 12), F.lit(".dart"))
    out = F.when(u.startswith("package:") & F.contains(rest, F.lit("/")), F.concat(folder, sanitize_path(path)))
    return out.when(u.startswith("dart:"), F.concat(F.lit("dart/"), sanitize_path(F.substring(u, F.lit(6), F.length(u))))).otherwise(digest)


#: Words that no identifier may be.
RESERVED = """abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends extension external factory false final finally for
Function get hide if implements import in interface is late library mixin new null of on operator part required rethrow return sealed set show static super switch sync this throw true try typedef var void
when while with yield""".split()


def ident_clean(x: Column | str) -> Column:
    """An identifier: other characters become _, and _ goes before digits, reserved words and nothing at all."""
    clean = F.regexp_replace(_c(x), "[^A-Za-z0-9_$]", "_")
    return F.when((clean == "") | clean.rlike("^[0-9]") | clean.isin(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def clean_symbol(x: Column | str) -> Column:
    """What stands before the private key, without angle brackets at its ends."""
    return F.btrim(F.split_part(_c(x), F.lit("@"), F.lit(1)), F.lit("<>"))


def lower_camel(x: Column | str) -> Column:
    """The first letter in lower case and no underscores in front of it; a name without letters stays; nothing becomes value."""
    lead = F.regexp_extract(_c(x), "^[^A-Za-z]*", 0)
    rest = F.substring(_c(x), F.length(lead) + 1, F.length(_c(x)))
    lowered = F.regexp_replace(F.concat(lead, F.lower(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))), "^_+", "")
    return F.when(_c(x) == "", "value").when(rest == "", _c(x)).otherwise(lowered)


def rename_prefix(source: Column | str, prefix: str = "aot") -> Column:
    """Source text whose import prefix makes room for a declaration of the same name: it gets as few underscores as no name has."""
    name = rf"(?<![A-Za-z0-9_$]){prefix}(?![A-Za-z0-9_$])"
    use = rf"(?:{name}(?=\.)|(?<=as ){name}(?=;))"
    declared = _c(source).rlike(rf"(?!{use}){name}")
    taken = F.transform(F.regexp_extract_all(_c(source), F.lit(rf"(?<![A-Za-z0-9_$]){prefix}_+(?![A-Za-z0-9_$])"), F.lit(0)), lambda w: F.length(w) - len(prefix))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(taken) + 1), taken))
    return F.when(declared, F.regexp_replace(_c(source), F.lit(use), F.concat(F.lit(prefix), F.repeat(F.lit("_"), free)))).otherwise(_c(source))


def escape_text(x: Column | str) -> Column:
    """Escapes backslash, quote, dollar, newline, return and tab; other control and direction marks become ?."""
    out = _c(x)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("$", "\\$"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[\\x00-\\x1f\\x7f\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]", "?")


def _after_last(path: Column, marker: str) -> Column:
    """What stands behind the last place of the marker; null if that is nothing, or there is no such place."""
    return F.when(F.contains(path, F.lit(marker)), F.nullif(F.substring_index(path, marker, -1), F.lit("")))


def path_to_uri(path: Column | str, package: str | None = None, lib_root: str | None = None) -> Column:
    """A library address from a source path: the application's lib folder, the framework's, the SDK's, or a hosted package's; else null."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    found: list[Column] = []
    if package is not None:
        own = [_after_last(p, f"/{package}/lib/")]
        if lib_root is not None:
            own.insert(0, F.when(p.startswith(lib_root + "/"), F.nullif(F.substring(p, F.lit(len(lib_root) + 2), F.length(p)), F.lit(""))))
        found = [F.concat(F.lit(f"package:{package}/"), x) for x in own]
    found.append(F.concat(F.lit("package:flutter/"), _after_last(p, "/packages/flutter/lib/")))
    found += [F.concat(F.lit("dart:"), F.split_part(_after_last(p, marker), F.lit("/"), F.lit(1))) for marker in ("/sdk/lib/", "/dart-sdk/lib/")]
    hosted = r"(?s)(?:^|/)pub\.dev/(?:([^/]+)-[^/-]*|([^/-]+))/lib/(.+)\z"
    name = F.concat(F.regexp_extract(p, hosted, 1), F.regexp_extract(p, hosted, 2))
    found.append(F.when(name != "", F.concat(F.lit("package:"), name, F.lit("/"), F.regexp_extract(p, hosted, 3))))
    return F.coalesce(*found)


def lib_root(path: Column | str) -> Column:
    """The path up to its last lib folder, or null."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    return F.when(F.contains(p, F.lit("/lib/")), F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/lib/", -1)) - 5), F.lit("/lib")))


def lib_root_package(root: Column | str) -> Column:
    """The folder above a lib folder, if its name can be a package's."""
    return F.nullif(F.regexp_extract(_c(root), r"(?:^|/)([a-z][a-z0-9_]*)/[^/]+/?\z", 1), F.lit(""))


def last_segment(x: Column | str) -> Column:
    return F.substring_index(_c(x), ".", -1)


def qualified_name(owner: Column | str, name: Column | str, bare: Column | None = None) -> Column:
    """owner.name, or the name alone for no owner, a top-level one, or where `bare` holds."""
    alone = _c(owner).isNull() | _c(owner).isin("::", "top_level")
    return F.when(alone if bare is None else alone | bare, _c(name)).otherwise(F.concat(_c(owner), F.lit("."), _c(name)))


def looks_like_class(x: Column | str) -> Column:
    """Whether the first sign behind underscores is a capital letter."""
    return _c(x).rlike("^_*[A-Z]")


def name_kind(x: Column | str) -> Column:
    """The kind of function that a debug name shows."""
    y = _c(x)
    setter = F.contains(y, F.lit("|set#")) | (y.endswith("=") & ~y.endswith("==") & ~y.endswith("[]="))
    return F.when(y.startswith("new "), "constructor").when(F.contains(y, F.lit("<anonymous closure>")), "closure").when(F.contains(y, F.lit("|get#")), "getter").when(setter, "setter").when(y.isNotNull(), "regular")


def split_name(x: Column | str) -> Column:
    """owner, name, kind of a debug name: `new X.y` is a constructor, X.y a member if X looks like a class, all else is top-level."""
    y = _c(x)
    made = F.substring(y, F.lit(5), F.length(y))
    is_new, member = y.startswith("new "), F.contains(y, F.lit(".")) & looks_like_class(F.split_part(y, F.lit("."), F.lit(1)))
    behind = lambda v: F.substring(v, F.locate(".", v) + 1, F.length(v))
    owner = F.when(is_new, F.split_part(made, F.lit("."), F.lit(1))).when(member, F.split_part(y, F.lit("."), F.lit(1))).otherwise("::")
    name = F.when(is_new & F.contains(made, F.lit(".")), behind(made)).when(is_new, "constructor").when(member, behind(y)).otherwise(y)
    return F.when(y.isNotNull(), F.struct(owner.alias("owner"), name.alias("name"), name_kind(y).alias("kind")))


def is_enum_member(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike(r"^[A-Za-z_][A-Za-z0-9_$]{0,127}\z"), F.lit(False))


def is_opaque_identity(x: Column | str) -> Column:
    """Whether an identity names nothing that another build would share."""
    return prefix_any(x, ["sub_", "snapshotRef(", "snapshotInstance(", "0x"])


def is_meaningful_target(x: Column | str) -> Column:
    """Call targets that source text shows: named ones, but for allocation and stack checks."""
    return ~_c(x).startswith("sub_") & ~F.contains(_c(x), F.lit("StackOverflow")) & ~_c(x).isin("AllocateObject", "AllocateArray")


def is_runtime_helper(x: Column | str) -> Column:
    """Stubs of the runtime, with spaces or underscores in their names."""
    return prefix_any(F.replace(_c(x), F.lit(" "), F.lit("_")), ["_iso_stub_", "_vm_stub_", "stub_"])


def is_internal_target(x: Column | str) -> Column:
    return prefix_any(x, ["String.", "_OneByteString.", "ListBase.", "_GrowableList.", "_Compact", "dart:"])


def target_scope(uri: Column | str, application: str | None, target: Column | str) -> Column:
    """Where a call leads: application, package, flutter_sdk, dart_sdk, runtime or unknown."""
    u = _c(uri)
    own = u.startswith(f"package:{application}/") if application else F.lit(False)
    known = F.when(own, "application").when(u.startswith("package:flutter/") | u.startswith("dart:ui"), "flutter_sdk").when(u.startswith("package:"), "package").when(u.startswith("dart:"), "dart_sdk")
    return known.when(is_runtime_helper(target), "runtime").otherwise("unknown")


def in_scope(uri: Column | str, scope: str, application: str | None = None) -> Column:
    """Declarations of a scope: all; packages, without the framework; app, none without a known application. Null is in no narrow scope."""
    u = _c(uri)
    if scope == "all":
        return F.lit(True)
    if scope == "packages":
        return F.coalesce(u.startswith("package:") & ~u.startswith("package:flutter/"), F.lit(False))
    return prefix_any(u, [f"package:{application}/"]) if application else F.lit(False)


def library_in_scope(uri: Column | str, scope: str, application: str | None = None) -> Column:
    """The same for libraries: what counts is the package by itself, so an address without a path has one too."""
    if scope == "all":
        return F.lit(True)
    package = package_of(uri)
    return F.coalesce(package != "flutter" if scope == "packages" else package == F.lit(application), F.lit(False))


#: Kinds of functions by the low five bits of their tag.
KINDS = """regular closure implicit_closure getter setter constructor implicit_getter implicit_setter implicit_static_getter field_initializer method_extractor no_such_method_dispatcher
invoke_field_dispatcher irregexp dynamic_invocation_forwarder ffi_trampoline record_field_getter""".split()


def function_kind(tag: Column | str) -> Column:
    """The kind of a function by the low five bits of its tag; null for numbers without a kind."""
    return F.get(F.array(*map(F.lit, KINDS)), _c(tag).bitwiseAND(F.lit(31)).cast("int"))


def is_static(tag: Column | str, kind: Column | str, static_bit: Column | int | None) -> Column:
    """Whether a member is static: kinds that settle it by definition, else the calibrated bit of the tag; null without one."""
    place = F.lit(static_bit).cast("int") if static_bit is None or isinstance(static_bit, int) else static_bit
    flag = F.when(place.isNotNull() & _c(tag).isNotNull(), F.getbit(_c(tag).cast("long"), place) == 1)
    return F.when(_c(kind).isin("constructor", "implicit_getter", "implicit_setter", "closure"), False).when(_c(kind) == "implicit_static_getter", True).otherwise(flag)


def latin1(x: Column | str) -> Column:
    """Text of bytes that are one character each."""
    return F.decode(_c(x), "ISO-8859-1")


def round_up(value: Column, alignment: Column | int) -> Column:
    """The least multiple of the alignment that is not below the value."""
    step = F.lit(alignment) if isinstance(alignment, int) else alignment
    return value + F.pmod(-value, step)


def _balanced(inner: Column) -> Column:
    """Whether round brackets close in order and none is left open."""
    depths = F.transform(F.regexp_extract_all(inner, F.lit("[()]"), F.lit(0)), lambda c: F.when(c == "(", 1).otherwise(-1))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    return F.aggregate(depths, state, lambda a, d: F.struct((a["depth"] + d).alias("depth"), F.least(a["least"], a["depth"] + d).alias("least")), lambda a: (a["depth"] == 0) & (a["least"] == 0))


def strip_parentheses(x: Column | str) -> Column:
    """Text without one pair of round brackets that encloses all of it."""
    y = _c(x)
    inner = F.substring(y, F.lit(2), F.length(y) - 2)
    return F.when((F.length(y) >= 2) & y.startswith("(") & y.endswith(")") & _balanced(inner), inner).otherwise(y)


def negate_condition(x: Column | str) -> Column:
    """The opposite of a condition: a negation around all of it falls away, the first comparison by this order turns, else it is negated as a whole."""
    y = _c(x)
    out = F.when((F.length(y) >= 3) & y.startswith("!(") & y.endswith(")") & _balanced(F.substring(y, F.lit(3), F.length(y) - 3)), F.substring(y, F.lit(3), F.length(y) - 3))
    for sign, other in (("==", "!="), ("!=", "=="), ("<", ">="), (">=", "<"), (">", "<="), ("<=", ">")):
        out = out.when(F.contains(y, F.lit(f" {sign} ")), F.regexp_replace(y, rf"(?s)^(.*?) \Q{sign}\E ", rf"$1 {other} "))
    return out.otherwise(F.concat(F.lit("!("), y, F.lit(")")))


def _split_index(text: str | None) -> tuple[str, str] | None:
    depth, at = 0, len(text or "") - 1
    if at < 0 or text[at] != "]":
        return None
    while at > 0:
        at -= 1
        sign = text[at]
        if sign in "'\"":
            return None
        if sign == "[" and not depth:
            array, index = text[:at], text[at + 1 : -1]
            return (array, index) if array and index and array[-1] != "<" else None
        depth += (sign in "])") - (sign in "[(")
    return None


def split_index(x: Column | str) -> Column:
    """array and index of an expression that ends in one outer pair of square brackets; null for others and where quotes hide brackets."""

    @F.pandas_udf("array string, index string")
    def split(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_split_index(v) or (None, None) for v in values], columns=["array", "index"])

    found = split(_c(x))
    return F.when(found["array"].isNotNull(), found)


def is_identifier(x: Column | str) -> Column:
    """Two to 128 characters of an identifier or operator path, private key, quotes and angle brackets aside."""
    y = F.btrim(F.split_part(_c(x), F.lit("@"), F.lit(1)), F.lit("'\"<>"))
    return y.rlike(r"^[A-Za-z_$][A-Za-z0-9_$.:+*/-]{1,127}\z")


def is_human_string(x: Column | str) -> Column:
    """Text that a person may have written: 4 to 1024 bytes, three letters, short or with a space, and no library address."""
    y = _c(x)
    letters = F.length(F.regexp_replace(y, "[^A-Za-z]", ""))
    plain = F.octet_length(y).between(4, 1024) & ~y.rlike("^(package|dart):") & ~F.contains(y, F.lit("\x00"))
    return plain & (y.rlike("^https?://") | ((letters >= 3) & (F.contains(y, F.lit(" ")) | (F.octet_length(y) <= 80))))


def prefix_any(x: Column | str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | _c(x).startswith(p)
    return F.coalesce(out, F.lit(False))


def abbreviate(x: Column | str, limit: int = 160) -> Column:
    return F.when(F.char_length(_c(x)) > limit, F.concat(F.substring(_c(x), 1, limit), F.lit("…"))).otherwise(_c(x))


#: Words that speak for text, and the ranges of characters that text is made of.
TEXT_MARKERS = ["http", "api", "token", "secret", "error", "message", "user", "pass", "flutter"]
TEXT_RANGES = r"\x{21}-\x{7e}\x{20}\t\n\f\r\x{a0}-\x{24f}\x{370}-\x{52f}\x{590}-\x{8ff}\x{900}-\x{97f}\x{2000}-\x{206f}\x{3000}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}"


def _path_like(y: Column) -> Column:
    allowed = F.contains(y, F.lit("/")) & y.rlike(r"^[A-Za-z0-9/\\._:?&=%#-]+\z")
    return allowed & (y.startswith("/") | F.contains(y, F.lit("./")) | F.exists(F.split(y, "/"), lambda s: F.contains(s, F.lit(".")) & (F.length(s) >= 3)))


def is_structured(x: Column | str) -> Column:
    """Addresses, bracketed text, paths, and text with an at sign and a dot."""
    y = _c(x)
    return F.contains(y, F.lit("://")) | (y.startswith("{") & y.endswith("}")) | (y.startswith("[") & y.endswith("]")) | _path_like(y) | (F.contains(y, F.lit("@")) & F.contains(y, F.lit(".")))


def text_score(x: Column | str) -> Column:
    """How much speaks for text: letters, digits and spaces up to a limit, structure and telling words; null if it is none.

    Rejected: lengths outside 4 to 2^20, control and uncommon characters, fewer than 4 letters or 3 distinct characters, much
    repetition, and single short words.
    """
    y = _c(x)
    count = F.char_length(y)
    letters, digits, spaces = (F.regexp_count(y, F.lit(p)) for p in (r"\p{IsAlphabetic}", "[0-9]", r"\p{IsWhite_Space}"))
    distinct, structured, wordy = F.size(F.array_distinct(F.split(y, ""))), is_structured(y), letters * 2 >= count
    rejected = ~count.between(4, 1 << 20) | ~y.rlike(rf"^[{TEXT_RANGES}]+\z") | y.rlike(r"[\p{Cc}&&[^\n\r\t]]") | (letters < 4) | (distinct < 3) | ((count >= 16) & (distinct * 8 < count))
    rejected = rejected | ~((spaces > 0) | structured | ((count >= 5) & wordy))
    marked = y.rlike("(?i)" + "|".join(TEXT_MARKERS))
    one = lambda flag, n: F.when(flag, n).otherwise(0)
    score = F.least(letters, F.lit(20)) + F.least(digits, F.lit(5)) + 2 * F.least(spaces, F.lit(8)) + one(count >= 8, 2) + one(wordy, 5) + one(structured, 18) + one(marked, 10)
    return F.when(~rejected, score.cast("long"))


def hex_decode(x: Column | str) -> Column:
    """Bytes of at least eight hexadecimal digits of even number, or null."""
    return F.when(_c(x).rlike("^([0-9a-fA-F]{2}){4,}$"), F.try_to_binary(_c(x), F.lit("hex")))


def base64_decode(x: Column | str) -> Column:
    """Bytes of well-formed base64, standard or for addresses, that shows itself by a digit, a sign or padding; else null. No bits may be left over."""
    y = _c(x)
    data = F.rtrim(F.translate(y, "-_", "+/"), F.lit("="))
    padding, rest = F.length(y) - F.length(data), F.length(data) % 4
    shape = F.octet_length(y).between(8, 1 << 20) & y.rlike(r"^[A-Za-z0-9+/_-]+={0,2}\z") & ((padding > 0) | y.rlike("[0-9+/]"))
    whole = F.when(padding == 0, rest != 1).otherwise(F.length(y) % 4 == 0)
    full = F.when(rest == 2, data.rlike(r"[AQgw]\z")).when(rest == 3, data.rlike(r"[AEIMQUYcgkosw048]\z")).otherwise(rest == 0)
    return F.when(shape & whole & full, F.try_to_binary(F.rpad(data, F.length(data) + F.pmod(-rest, F.lit(4)), F.lit("=")), F.lit("base64")))


def utf8_gate(x: Column) -> Column:
    """The text of valid UTF-8 bytes, or null."""
    return F.try_validate_utf8(x.cast("string"))


def bit(x: Column | str, place: int | Column) -> Column:
    return F.getbit(_c(x).cast("long"), F.lit(place) if isinstance(place, int) else place)


#: An element of an array that may describe arguments: its kind (integer, string, null, other), and its number or text.
ELEMENT = "kind string, number bigint, text string"


def decode_arguments(elements: Column) -> Column:
    """type_args, count, size, positional and named (name, position) of an array of ELEMENT structs; null if it describes no arguments.

    Four counts, a name and a place for each argument that is not positional, then one null; places are distinct and behind
    the positional ones.
    """
    number = lambda e: F.when((e["kind"] == "integer") & (e["number"] >= 0), e["number"])
    counts = [number(F.get(elements, F.lit(k))) for k in range(4)]
    count, positional = counts[1], counts[3]
    inner = lambda k: (k >= 4) & (k < F.size(elements) - 1) & (k % 2 == 0)
    pair = lambda e, k: F.struct(F.when((e["kind"] == "string") & (e["text"] != ""), e["text"]).alias("name"), number(F.get(elements, k + 1)).alias("position"))
    named = F.filter(F.transform(elements, lambda e, k: F.when(inner(k), pair(e, k))), lambda v: v.isNotNull())
    places = F.transform(named, lambda v: v["position"])
    good = (F.size(elements) - 5 == 2 * (count - positional)) & (positional <= count) & (F.element_at(elements, -1)["kind"] == "null")
    good = good & F.forall(named, lambda v: v["name"].isNotNull() & F.coalesce((v["position"] >= positional) & (v["position"] < count), F.lit(False)))
    good = good & (F.size(F.array_distinct(places)) == F.size(places)) & counts[0].isNotNull() & counts[2].isNotNull()
    return F.when(F.when(F.size(elements) >= 5, good).otherwise(F.lit(False)), F.struct(*[c.alias(n) for c, n in zip(counts, ("type_args", "count", "size", "positional"), strict=True)], named.alias("named")))


def _quoted(x: Column) -> Column:
    listed = F.to_json(F.array(x))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def arguments_fields(shape: Column) -> Column:
    named = F.array_join(F.transform(shape["named"], lambda v: F.concat(_quoted(v["name"]), F.lit("@"), v["position"].cast("string"))), ",")
    counts = F.concat(*[F.concat(F.lit(label), shape[field].cast("string")) for label, field in (("typeArgs=", "type_args"), (", count=", "count"), (", positional=", "positional"))])
    return F.when(F.size(shape["named"]) > 0, F.concat(counts, F.lit(", named=["), named, F.lit("]"))).otherwise(counts)


def arguments_label(shape: Column) -> Column:
    """The label of a decoded descriptor."""
    return F.concat(F.lit("argsDescriptor("), arguments_fields(shape), F.lit(")"))


def parse_arguments_label(label: Column | str) -> Column:
    """type_args, count, size, positional, named of a label of arguments, or of a dynamic call behind its quoted selector; size is the count, as labels hold none."""
    text = r'"(?:[^"\\]|\\.)*"'
    y = _c(label)
    fields = F.coalesce(*[F.nullif(F.regexp_extract(y, p, 1), F.lit("")) for p in (r"(?s)^argsDescriptor\((.*)\)\z", rf"(?s)^dynamicCall\({text}, (.*)\)\z")])
    value = lambda key: F.nullif(F.regexp_extract(fields, rf"(?:^|, ){key}=([0-9]{{1,18}})(?:, |\z)", 1), F.lit("")).cast("long")
    listed = F.regexp_extract(fields, r"(?s)named=\[(.*)\]\z", 1)
    whole = ~F.contains(fields, F.lit("named=[")) | (fields.endswith("]") & listed.rlike(rf"(?s)^(?:{text}@[0-9]+,?)*\z"))
    names, places = (F.regexp_extract_all(listed, F.lit(rf"(?s)({text})@([0-9]+)"), F.lit(k)) for k in (1, 2))
    pair = lambda n, p: F.struct(F.get(F.from_json(F.concat(F.lit("["), n, F.lit("]")), "array<string>"), F.lit(0)).alias("name"), p.cast("long").alias("position"))
    counts = [value("typeArgs"), value("count"), value("count"), value("positional")]
    good = whole & counts[0].isNotNull() & counts[1].isNotNull() & counts[3].isNotNull()
    return F.when(good, F.struct(*[c.alias(n) for c, n in zip(counts, ("type_args", "count", "size", "positional"), strict=True)], F.zip_with(names, places, pair).alias("named")))


def top_level_arity(x: Column | str) -> Column:
    """Number of arguments of a list with nested angle brackets; null if the brackets do not balance."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        n = a["n"] + F.when((c == ",") & (a["depth"] == 0), 1).otherwise(0)
        return F.struct(depth.alias("depth"), n.alias("n"), (a["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(F.split(_c(x), ""), start, step, lambda a: F.when(a["ok"] & (a["depth"] == 0), a["n"].cast("long")))


def named_arguments(values: Column, names: Column) -> Column:
    """Values with names in front as far as there are names; null dummies at either end are omitted arguments."""
    known = lambda v: v != "null"
    places = F.filter(F.transform(values, lambda v, k: F.when(known(v), k)), lambda k: k.isNotNull())
    kept = F.when(F.size(places) > 0, F.slice(values, F.array_min(places) + 1, F.array_max(places) - F.array_min(places) + 1)).otherwise(F.array().cast("array<string>"))
    return F.transform(kept, lambda v, k: F.when(F.get(names, k).isNotNull() & (F.get(names, k) != ""), F.concat(F.get(names, k), F.lit(": "), v)).otherwise(v))
