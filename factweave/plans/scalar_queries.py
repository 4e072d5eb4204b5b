"""Scalar functions and filters, one projection each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from ..operators import aggregates
from .registry import Tables, query


@query("""SELECT p_partkey, CAST(CASE WHEN h ~ '^[0-9a-fA-F]+$' THEN CAST('0x' || h AS BIGINT) END AS BIGINT) AS value FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'zz' ELSE format('{:x}', p_partkey * 7919) END AS h FROM part)""")
def hex_parse(t: Tables) -> DataFrame:
    h = F.when(F.col("p_partkey") % 7 == 0, "zz").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(F.col("p_partkey") * 7919))))
    return t.part.select("p_partkey", X.hex_parse(h).cast("long").alias("value"))


@query("""SELECT page_id, CASE WHEN regexp_full_match(u, '[A-Za-z0-9:/_.-]+') THEN u END AS uri FROM (SELECT page_id, regexp_extract(CASE page_id % 5 WHEN 0 THEN 'junk package:app/p' || page_id || '.dartZ' WHEN 1 THEN 'dart:core/x' || page_id || '.dart, tail.dart'
 WHEN 2 THEN 'package:a b/' || page_id || '.dart' WHEN 3 THEN 'see dart:ui then package:x/' || page_id || '.dart' ELSE url END, '(?s)(?:package:|dart:).*?\\.dart', 0) AS u FROM pages)""")
def extract_uri(t: Tables) -> DataFrame:
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    noisy = F.when(k == 0, F.concat(F.lit("junk package:app/p"), i, F.lit(".dartZ"))).when(k == 1, F.concat(F.lit("dart:core/x"), i, F.lit(".dart, tail.dart"))).when(k == 2, F.concat(F.lit("package:a b/"), i, F.lit(".dart")))
    return t.pages.select("page_id", X.extract_uri(noisy.when(k == 3, F.concat(F.lit("see dart:ui then package:x/"), i, F.lit(".dart"))).otherwise(F.col("url"))).alias("uri"))


_PKG = "CASE WHEN page_id % 3 = 0 THEN url ELSE 'package:' || regexp_replace(url, '^https?://', '') END"


def _packaged(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("package:"), F.regexp_replace("url", "^https?://", ""))).alias("uri"))


@query(f"SELECT page_id, CASE WHEN starts_with(u, 'package:') THEN split_part(substr(u, 9), '/', 1) END AS package FROM (SELECT page_id, {_PKG} AS u FROM pages)")
def package_of(t: Tables) -> DataFrame:
    return _packaged(t).select("page_id", X.package_of("uri").alias("package"))


@query("SELECT p_partkey, regexp_replace(p_name || '@' || CAST(p_partkey AS VARCHAR) || '.x', '@[0-9]+', '', 'g') AS name FROM part")
def strip_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.strip_key(F.concat("p_name", F.lit("@"), "p_partkey", F.lit(".x"))).alias("name"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ring_x ring', ' '), lambda w: CASE WHEN w = 'ring' THEN 'RING' ELSE w END), ' ') AS name FROM part")
def token_replace(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.token_replace(F.concat("p_name", F.lit(" ring_x ring")), "ring", "RING").alias("name"))


@query("""SELECT p_partkey, CASE p_name WHEN 'small ring' THEN 'tiny' ELSE regexp_replace(regexp_replace(p_name || '.' || p_name || '(red_' || p_name || ')', '\\bred\\b', 'rouge', 'g'), '\\bblue\\b', 'bleu', 'g') END AS name FROM part""")
def token_map(t: Tables) -> DataFrame:
    """Names within larger expressions; a whole name that has a mapping takes it."""
    text = F.when(F.col("p_name") == "small ring", F.col("p_name")).otherwise(F.concat("p_name", F.lit("."), "p_name", F.lit("(red_"), "p_name", F.lit(")")))
    return t.part.select("p_partkey", X.token_map(text, {"small ring": "tiny", "red": "rouge", "blue": "bleu"}).alias("name"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_type || ' < ' || p_brand || ' >??', '\\s+', '', 'g'), '\\?+$', '') AS type FROM part")
def canonical_type(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.canonical_type(F.concat("p_type", F.lit(" < "), "p_brand", F.lit(" >??"))).alias("type"))


@query("SELECT p_partkey, regexp_extract(p_type || CASE WHEN p_partkey % 2 = 0 THEN '<int>?' ELSE '?' END, '^([^<?]*)', 1) AS root FROM part")
def type_root(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.type_root(F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, "<int>?").otherwise("?"))).alias("root"))


_CLEAN = "array_to_string(list_transform(list_filter(string_split({}, '/'), lambda x: x NOT IN ('', '.', '..')), lambda x: regexp_replace(x, '[^A-Za-z0-9_.-]', '_', 'g')), '/')"
_EXTENDED = "CASE WHEN {0} <> '' AND NOT regexp_matches(list_extract(string_split({0}, '/'), -1), '^.+\\.') THEN {0} || '.{1}' ELSE {0} END"


@query(f"SELECT page_id, {_EXTENDED.format('p', 'html')} AS path FROM (SELECT page_id, {_CLEAN.format('u')} AS p FROM (SELECT page_id, './../' || regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 3 = 0 THEN '.x' ELSE '' END AS u FROM pages))")
def sanitize_path(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("./../"), F.regexp_replace("url", "^https?://", ""), F.when(F.col("page_id") % 3 == 0, ".x").otherwise(""))
    return t.pages.select("page_id", X.sanitize_path(raw, "html").alias("path"))


_OUT = f"SELECT page_id, u, CASE WHEN starts_with(u, 'package:') THEN split_part(substr(u, 9), '/', 1) END AS package, {_CLEAN.format('v')} AS p FROM (SELECT page_id, u, CASE WHEN starts_with(u, 'package:') THEN substr(u, 10 + length(split_part(substr(u, 9), '/', 1))) ELSE substr(u, 6) END AS v FROM (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'dart:' || substr(url, length(url) - 4) WHEN page_id % 4 = 2 THEN 'package:app/' || substr(url, length(url) - 6) ELSE {_PKG} END AS u FROM pages))"


@query(f"SELECT page_id, CASE WHEN starts_with(u, 'package:') THEN CASE WHEN package = 'app' THEN '' ELSE 'packages/' || package || '/' END || {_EXTENDED.format('p', 'dart')} WHEN starts_with(u, 'dart:') THEN 'dart/' || {_EXTENDED.format('p', 'dart')} ELSE 'recovered_' || substr(sha256(u), 1, 12) || '.dart' END AS path FROM ({_OUT})")
def output_path(t: Tables) -> DataFrame:
    k, tail = F.col("page_id") % 4, lambda n: F.substring("url", F.length("url") - n, F.length("url"))
    uri = F.when(k == 1, F.concat(F.lit("dart:"), tail(4))).when(k == 2, F.concat(F.lit("package:app/"), tail(6))).otherwise(F.col("uri"))
    return _packaged(t).join(t.pages.select("page_id", "url"), "page_id").select("page_id", X.output_path(uri, "app").alias("path"))


@query("""SELECT p_partkey, CASE WHEN c = '' OR c ~ '^[0-9].*' OR c = 'class' THEN '_' || c ELSE c END AS ident FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'class' WHEN p_partkey % 5 = 1 THEN CAST(p_size AS VARCHAR) || 'x' ELSE regexp_replace(p_name, '[^A-Za-z0-9_$]', '_', 'g') END AS c FROM part)""")
def ident_clean(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 0, "class").when(F.col("p_partkey") % 5 == 1, F.concat(F.col("p_size").cast("string"), F.lit("x"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.ident_clean(raw).alias("ident"))


@query("""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '''', chr(92) || ''''), '$', chr(92) || '$'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), '[\\x00-\\x1f\\x7f\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', '?', 'g') AS escaped FROM documents""")
def escape_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.escape_text("text").alias("escaped"))


_PATH = """CASE page_id % 9 WHEN 0 THEN '/home/x/app/lib/' || page_id || '/a.dart' WHEN 1 THEN '/f/packages/flutter/lib/src/' || page_id || '.dart' WHEN 2 THEN 'C:' || chr(92) || 'sdk' || chr(92) || 'sdk' || chr(92) || 'lib' || chr(92) || 'core' || page_id || chr(92) || 'l.dart'
 WHEN 3 THEN '/x/dart-sdk/lib/io' || page_id || '/f.dart' WHEN 4 THEN '/c/pub.dev/my-pkg' || page_id || '-1.2.' || page_id || '/lib/src/a.dart' WHEN 5 THEN '/r/lib/' || page_id || '.dart' WHEN 6 THEN '/c/pub.dev/pkg/bin/a.dart' WHEN 7 THEN '/app/lib/app/lib/' || page_id || '.dart' ELSE url END"""


@query(f"""WITH p AS (SELECT page_id, replace({_PATH}, chr(92), '/') AS p FROM pages), m AS (SELECT page_id, p, regexp_extract(p, '^.*/app/lib/(.*)$', 1) AS own, list_extract(string_split(p, '/packages/flutter/lib/'), -1) AS framework,
 split_part(list_extract(string_split(p, '/sdk/lib/'), -1), '/', 1) AS sdk, split_part(list_extract(string_split(p, '/dart-sdk/lib/'), -1), '/', 1) AS dart, regexp_extract(p, '(?:^|/)pub\\.dev/(?:([^/]+)-[^/-]*|([^/-]+))/lib/(.+)$', ['a', 'b', 'c']) AS h FROM p)
 SELECT page_id, CASE WHEN starts_with(p, '/r/lib/') THEN 'package:app/' || substr(p, 8) WHEN contains(p, '/app/lib/') THEN 'package:app/' || own WHEN contains(p, '/packages/flutter/lib/') THEN 'package:flutter/' || framework
 WHEN contains(p, '/sdk/lib/') THEN 'dart:' || sdk WHEN contains(p, '/dart-sdk/lib/') THEN 'dart:' || dart WHEN h.c <> '' THEN 'package:' || h.a || h.b || '/' || h.c END AS uri FROM m""")
def path_to_uri(t: Tables) -> DataFrame:
    """Paths of an application below its own lib folders, of the framework, of two SDK layouts, of hosted packages, and others."""
    return t.pages.select("page_id", X.path_to_uri(F.expr(_PATH.replace("chr(92)", "char(92)")), "app", "/r/lib").alias("uri"))


@query("SELECT page_id, list_extract(string_split(url, '.'), -1) AS segment FROM pages")
def last_segment(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.last_segment("url").alias("segment"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_name ELSE p_brand || '.' || p_name END AS qualified FROM part")
def qualified_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.qualified_name("p_brand", "p_name", F.col("p_type") == "PROMO").alias("qualified"))


_NAME = "CASE p_partkey % 6 WHEN 0 THEN 'new Widget.' || p_size WHEN 1 THEN 'new Widget' || p_size WHEN 2 THEN '_Brand.' || p_name || '=' WHEN 3 THEN p_name || '.x' WHEN 4 THEN 'A.b|get#' || p_size ELSE p_name || '[]=' END"


@query(f"""WITH n AS (SELECT p_partkey, {_NAME} AS n FROM part) SELECT p_partkey, CASE WHEN starts_with(n, 'new ') THEN split_part(substr(n, 5), '.', 1) WHEN regexp_matches(n, '^_*[A-Z][^.]*\\.') THEN split_part(n, '.', 1) ELSE '::' END AS owner,
 CASE WHEN starts_with(n, 'new ') THEN CASE WHEN contains(n, '.') THEN substr(n, strpos(n, '.') + 1) ELSE 'constructor' END WHEN regexp_matches(n, '^_*[A-Z][^.]*\\.') THEN substr(n, strpos(n, '.') + 1) ELSE n END AS name,
 CASE WHEN starts_with(n, 'new ') THEN 'constructor' WHEN contains(n, '|get#') THEN 'getter' WHEN ends_with(n, '=') AND NOT ends_with(n, '==') AND NOT ends_with(n, '[]=') THEN 'setter' ELSE 'regular' END AS kind FROM n""")
def split_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.split_name(F.expr(_NAME)).alias("n")).select("p_partkey", "n.owner", "n.name", "n.kind")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS decoded FROM part")
def utf8_gate(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.col("p_name").cast("binary"))).otherwise(F.col("p_name").cast("binary"))
    return t.part.select("p_partkey", X.utf8_gate(raw).alias("decoded"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS decoded FROM part")
def hex_decode(t: Tables) -> DataFrame:
    coded = F.concat(F.hex("p_name"), F.when(F.col("p_partkey") % 4 == 0, "0").otherwise(""))
    return t.part.select("p_partkey", X.hex_decode(coded).cast("string").alias("decoded"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(b, '[0-9+/=]') AND length(b) >= 8 THEN p_name END AS decoded FROM (SELECT *, to_base64(encode(p_name)) AS b FROM part)")
def base64_decode(t: Tables) -> DataFrame:
    """Half of the texts in the letters for addresses and without padding."""
    coded = F.base64(F.col("p_name").cast("binary"))
    bare = F.when((F.col("p_partkey") % 2 == 0) & coded.rlike("[0-9+/]"), F.translate(F.rtrim(coded, F.lit("=")), "+/", "-_")).otherwise(coded)
    shown = F.when(bare.rlike("[0-9=]"), bare).otherwise(coded)
    return t.part.select("p_partkey", X.base64_decode(shown).cast("string").alias("decoded"))


_TEXT = """CASE p_partkey % 8 WHEN 0 THEN 'aaaa' WHEN 1 THEN 'https://' || p_partkey || '.example.org/api' WHEN 2 THEN '{' || p_name || ': ' || p_partkey || '}' WHEN 3 THEN 'lib/' || p_partkey || '.dart' WHEN 4 THEN p_name || ' error ' || p_brand
 WHEN 5 THEN repeat('abc', 12) WHEN 6 THEN p_type || '@x.org' ELSE p_name END"""
_STRUCTURED = """contains(x, '://') OR (starts_with(x, '{') AND ends_with(x, '}')) OR (regexp_full_match(x, '[A-Za-z0-9/._:?&=%#-]+') AND contains(x, '/') AND (starts_with(x, '/') OR contains(x, './') OR len(list_filter(string_split(x, '/'), lambda s: contains(s, '.') AND length(s) >= 3)) > 0)) OR (contains(x, '@') AND contains(x, '.'))"""


@query(f"""WITH x AS (SELECT p_partkey, {_TEXT} AS x FROM part), f AS (SELECT *, length(x) AS n, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(x, '[^0-9]', '', 'g')) AS d, length(regexp_replace(x, '[^ ]', '', 'g')) AS w,
 len(list_distinct(string_split(x, ''))) AS u, ({_STRUCTURED}) AS s FROM x)
 SELECT p_partkey, CAST(CASE WHEN n < 4 OR a < 4 OR u < 3 OR (n >= 16 AND u * 8 < n) OR NOT (w > 0 OR s OR (n >= 5 AND a * 2 >= n)) THEN NULL ELSE least(a, 20) + least(d, 5) + 2 * least(w, 8) + CASE WHEN n >= 8 THEN 2 ELSE 0 END
 + CASE WHEN a * 2 >= n THEN 5 ELSE 0 END + CASE WHEN s THEN 18 ELSE 0 END + CASE WHEN regexp_matches(lower(x), 'http|api|token|secret|error|message|user|pass|flutter') THEN 10 ELSE 0 END END AS BIGINT) AS score FROM f""")
def text_score(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.text_score(F.expr(_TEXT)).alias("score"))


#: Arrays that may describe arguments: two named ones for every fifth row, and rows that break one rule each.
_ARGUMENTS = """CASE vec_id % 8 WHEN 0 THEN array(i(label % 2), i(2), i(2), i(2), z()) WHEN 1 THEN array(i(0), i(4), i(4), i(2), s('a'), i(3), s(concat('n', cast(label AS string))), i(2), z()) WHEN 2 THEN array(i(0), i(2), i(2), i(2))
 WHEN 3 THEN array(i(0), i(3), i(3), i(2), s('a'), i(0), z()) WHEN 4 THEN array(i(0), i(4), i(4), i(2), s('a'), i(3), s('b'), i(3), z()) WHEN 5 THEN array(i(0), i(3), i(3), i(2), s(''), i(2), z()) WHEN 6 THEN array(i(-1), i(2), i(2), i(2), z()) ELSE array(i(1), i(3), i(1), i(2), s('k'), i(2), z()) END"""


def _elements() -> str:
    import re

    out = re.sub(r"i\(([^()]*)\)", r"named_struct('kind', 'integer', 'number', cast(\1 AS bigint), 'text', cast(null AS string))", _ARGUMENTS)
    out = out.replace("z()", "named_struct('kind', 'null', 'number', cast(null AS bigint), 'text', cast(null AS string))")
    return re.sub(r"\bs\((concat\('n', cast\(label AS string\)\)|'[a-z]*')\)", r"named_struct('kind', 'string', 'number', cast(null AS bigint), 'text', \1)", out)


_SHAPE = "CASE vec_id % 8 WHEN 0 THEN 'typeArgs=' || (label % 2) || ', count=2, positional=2' WHEN 1 THEN 'typeArgs=0, count=4, positional=2, named=[\"a\"@3,\"n' || label || '\"@2]' WHEN 7 THEN 'typeArgs=1, count=3, positional=2, named=[\"k\"@2]' END"


@query(f"SELECT vec_id, 'argsDescriptor(' || {_SHAPE} || ')' AS label, CAST(CASE vec_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 7 THEN 1 END AS BIGINT) AS named FROM embeddings")
def array_decode(t: Tables) -> DataFrame:
    """Arrays are decoded if they keep all rules of a descriptor, else they are none."""
    shape = t.embeddings.select("vec_id", X.decode_arguments(F.expr(_elements())).alias("a"))
    return shape.select("vec_id", X.arguments_label(F.col("a")).alias("label"), F.when(F.col("a").isNotNull(), F.size("a.named")).cast("long").alias("named"))


@query(f"""WITH s AS (SELECT vec_id, label, {_SHAPE} AS f FROM embeddings) SELECT vec_id, f AS fields, CAST(CASE vec_id % 8 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 7 THEN 5 END AS BIGINT) AS total, CASE vec_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'a|n' || label WHEN 7 THEN 'k' END AS names FROM s WHERE f IS NOT NULL""")
def label_roundtrip(t: Tables) -> DataFrame:
    """Labels of descriptors and of dynamic calls, parsed again."""
    shape = t.embeddings.select("vec_id", X.decode_arguments(F.expr(_elements())).alias("a")).where("a IS NOT NULL")
    label = F.when(F.col("vec_id") % 2 == 0, X.arguments_label(F.col("a"))).otherwise(F.concat(F.lit('dynamicCall("x, \\"y", '), X.arguments_fields(F.col("a")), F.lit(")")))
    back = shape.select("vec_id", X.parse_arguments_label(label).alias("a"))
    return back.select("vec_id", X.arguments_fields(F.col("a")).alias("fields"), (F.col("a.count") + F.col("a.positional")).alias("total"), F.array_join(F.transform("a.named", lambda n: n["name"]), "|").alias("names"))


@query("""WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS p FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey, p, unnest(range(0, len(p), 3)) AS k FROM a)
 SELECT l_orderkey, CAST(k // 3 AS BIGINT) AS chunk, array_to_string(p[k + 1 : k + 3], '|') AS parts FROM i""")
def triplets(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    i = a.select("l_orderkey", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1, F.lit(3))).alias("k"))
    return i.select("l_orderkey", F.expr("k div 3").alias("chunk"), F.array_join(F.slice("p", F.col("k") + 1, F.lit(3)), "|").alias("parts"))


_URI = "CASE page_id % 7 WHEN 0 THEN 'package:flutter/' || page_id WHEN 1 THEN 'package:app/' || page_id WHEN 2 THEN 'package:app' WHEN 3 THEN 'dart:core' WHEN 4 THEN NULL WHEN 5 THEN 'package:other/' || page_id ELSE url END"


@query(f"""WITH u AS (SELECT page_id, {_URI} AS u FROM pages) SELECT page_id, coalesce(starts_with(u, 'package:') AND NOT starts_with(u, 'package:flutter/'), false) AS packages, coalesce(starts_with(u, 'package:app/'), false) AS app, coalesce(starts_with(u, 'package:') AND split_part(substr(u, 9), '/', 1) <> 'flutter', false) AS package_library,
 coalesce(starts_with(u, 'package:') AND split_part(substr(u, 9), '/', 1) = 'app', false) AS app_library, CASE WHEN starts_with(u, 'package:app/') THEN 'application' WHEN starts_with(u, 'package:flutter/') THEN 'flutter_sdk' WHEN starts_with(u, 'package:') THEN 'package' WHEN starts_with(u, 'dart:') THEN 'dart_sdk' WHEN page_id % 2 = 0 THEN 'runtime' ELSE 'unknown' END AS scope FROM u""")
def scope_filters(t: Tables) -> DataFrame:
    """Scopes of declarations and of libraries, and of call targets."""
    u = t.pages.select("page_id", F.expr(_URI).alias("u"))
    target = F.when(F.col("page_id") % 2 == 0, "stub call").otherwise("call")
    return u.select("page_id", X.in_scope("u", "packages").alias("packages"), X.in_scope("u", "app", "app").alias("app"), X.library_in_scope("u", "packages").alias("package_library"), X.library_in_scope("u", "app", "app").alias("app_library"), X.target_scope("u", "app", target).alias("scope"))


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(nullif(p_type, 'PROMO'), 'S')")
def scope_filter_strict(t: Tables) -> DataFrame:
    scope = F.nullif("p_type", F.lit("PROMO"))
    return t.part.where(X.prefix_any(scope, ["S"])).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE nullif(p_type, 'PROMO') IS NULL OR NOT starts_with(p_type, 'S')")
def scope_filter_lenient(t: Tables) -> DataFrame:
    scope = F.nullif("p_type", F.lit("PROMO"))
    return t.part.where(scope.isNull() | ~scope.startswith("S")).select("p_partkey", "p_type")


@query("SELECT page_id, starts_with(url, 'https://m.') OR starts_with(url, 'http://blog.') AS framework FROM pages")
def prefix_any(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.prefix_any("url", ["https://m.", "http://blog."]).alias("framework"))


_OWNED = "CASE WHEN page_id % 11 = 0 THEN 'package:app/' || (page_id % 3) WHEN page_id % 11 = 1 THEN 'dart:x' || (page_id % 2) WHEN page_id % 11 = 2 THEN url WHEN page_id % 11 = 3 THEN '' ELSE substr(md5(url), 1, 6) END"
_OWNERSHIP = f"""SELECT *, opaque >= 8 AND opaque > 2 * recognised AND (application > 0 OR (compact >= 8 AND 4 * compact >= 3 * opaque)) AS obfuscated FROM (SELECT CAST(count_if(regexp_matches(u, '^(dart:|package:|file:|org-dartlang-)')) AS BIGINT) AS recognised, CAST(count_if(NOT regexp_matches(u, '^(dart:|package:|file:|org-dartlang-)')) AS BIGINT) AS opaque,
 CAST(count_if(regexp_full_match(u, '[A-Za-z0-9_$]{{1,8}}')) AS BIGINT) AS compact, CAST(count_if(starts_with(u, 'package:app/')) AS BIGINT) AS application FROM (SELECT DISTINCT {_OWNED} AS u FROM pages) WHERE u <> '')"""


def _owned(t: Tables) -> DataFrame:
    return aggregates.ownership(t.pages.select(F.expr(_OWNED).alias("uri")), "uri", "app")


@query(_OWNERSHIP)
def opaque_ratio_flag(t: Tables) -> DataFrame:
    return _owned(t)


@query(f"SELECT page_id FROM pages, ({_OWNERSHIP}) WHERE obfuscated OR starts_with(url, 'https://m.')")
def adaptive_scope(t: Tables) -> DataFrame:
    """A narrow scope becomes all rows if ownership looks obfuscated; the flag is one row."""
    flag = F.broadcast(_owned(t).select("obfuscated"))
    return t.pages.join(flag, F.col("obfuscated") | F.col("url").startswith("https://m.")).select("page_id")


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS words, CAST(count_if(regexp_matches(trim(split_part(w, '@', 1), '''"<>'), '^[A-Za-z_$][A-Za-z0-9_$.:+*/-]{1,127}$')) AS BIGINT) AS identifiers FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1""")
def is_identifier(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.filter("w", X.is_identifier)).cast("long").alias("identifiers"))


_HUMAN = "strlen(x) BETWEEN 4 AND 1024 AND NOT regexp_matches(x, '^(package|dart):') AND (regexp_matches(x, '^https?://') OR (length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3 AND (contains(x, ' ') OR strlen(x) <= 80)))"


@query(f"SELECT doc_id, {_HUMAN} AS human FROM (SELECT doc_id, split_part(text, chr(10), 1) AS x FROM documents)")
def is_human_string(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.is_human_string(F.split_part("text", F.lit("\n"), F.lit(1))).alias("human"))


@query("""SELECT page_id, CAST(len(r) AS BIGINT) AS runs, CAST(list_max(list_transform(r, lambda x: length(x))) AS BIGINT) AS longest FROM (SELECT page_id, regexp_extract_all(html, '[\\t\\x20-\\x7e]{4,}') AS r FROM pages)""")
def printable_runs(t: Tables) -> DataFrame:
    runs = t.pages.select("page_id", F.regexp_extract_all("html", F.lit("[\\t\\x20-\\x7e]{4,}"), F.lit(0)).alias("r"))
    return runs.select("page_id", F.size("r").cast("long").alias("runs"), F.array_max(F.transform("r", F.length)).cast("long").alias("longest"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…' ELSE text END AS short FROM documents")
def abbreviate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.abbreviate("text").alias("short"))


_KINDS_SQL = "['" + "', '".join(X.KINDS) + "']"


@query(f"""WITH k AS (SELECT o_orderkey, o_orderkey & 1023 AS tag FROM orders), n AS (SELECT *, CASE WHEN tag & 31 <= 16 THEN list_extract({_KINDS_SQL}, CAST(tag & 31 AS INTEGER) + 1) END AS kind FROM k)
 SELECT o_orderkey, kind, CASE WHEN kind IN ('constructor', 'implicit_getter', 'implicit_setter', 'closure') THEN false WHEN kind = 'implicit_static_getter' THEN true ELSE (tag >> 7) & 1 = 1 END AS is_static FROM n""")
def function_tags(t: Tables) -> DataFrame:
    """Kinds and static flags of packed tags, with bit 7 calibrated."""
    k = t.orders.select("o_orderkey", F.col("o_orderkey").bitwiseAND(F.lit(1023)).alias("tag")).withColumn("kind", X.function_kind("tag"))
    return k.select("o_orderkey", "kind", X.is_static("tag", "kind", 7).alias("is_static"))


_TARGET = "CASE p_partkey % 7 WHEN 0 THEN 'sub_' || p_partkey WHEN 1 THEN 'stub ' || p_name WHEN 2 THEN '_OneByteString.' || p_name WHEN 3 THEN 'AllocateArray' WHEN 4 THEN 'xStackOverflowY' WHEN 5 THEN '0x' || p_partkey ELSE p_brand END"


@query(f"""WITH x AS (SELECT p_partkey, {_TARGET} AS x FROM part) SELECT p_partkey, NOT (starts_with(x, 'sub_') OR contains(x, 'StackOverflow') OR x IN ('AllocateObject', 'AllocateArray')) AS meaningful, starts_with(replace(x, ' ', '_'), 'stub_') AS helper, starts_with(x, '_OneByteString.') AS internal,
 starts_with(x, 'sub_') OR starts_with(x, '0x') AS opaque, regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_$]{{0,127}}') AS member, regexp_matches(x, '^_*[A-Z]') AS class_name FROM x""")
def target_predicates(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.expr(_TARGET).alias("x"))
    return x.select("p_partkey", X.is_meaningful_target("x").alias("meaningful"), X.is_runtime_helper("x").alias("helper"), X.is_internal_target("x").alias("internal"), X.is_opaque_identity("x").alias("opaque"), X.is_enum_member("x").alias("member"), X.looks_like_class("x").alias("class_name"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' != 1' WHEN 1 THEN p_name WHEN 2 THEN 'a >= ' || p_partkey WHEN 3 THEN '!(!(a) && (' || p_name || '))' ELSE '!(' || p_name || ')' END AS negated,
 CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '(a) + (' || p_name || ')' END AS bare, CAST(CAST(ceil((p_partkey % 100) / 16.0) AS BIGINT) * 16 AS BIGINT) AS aligned FROM part""")
def expression_rules(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    condition = F.when(k == 0, F.concat(n, F.lit(" == 1"))).when(k == 1, F.concat(F.lit("!("), n, F.lit(")"))).when(k == 2, F.concat(F.lit("a < "), F.col("p_partkey").cast("string"))).when(k == 3, F.concat(F.lit("!(a) && ("), n, F.lit(")"))).otherwise(n)
    wrapped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(F.lit("(a) + ("), n, F.lit(")")))
    return t.part.select("p_partkey", X.negate_condition(condition).alias("negated"), X.strip_parentheses(wrapped).alias("bare"), X.round_up(F.col("p_partkey") % 100, 16).alias("aligned"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform({0}, lambda b: b::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"

_LETTERS = "list_transform(string_split(p_name, ''), lambda c: ascii(c))"


@query(f"SELECT p_partkey, CAST({_FNV.format(_LETTERS)} AS DECIMAL(20, 0)) AS hash FROM part")
def fnv_hash(t: Tables) -> DataFrame:
    """FNV-1a of 64 bits, bit by bit."""
    return t.part.select("p_partkey", K.fnv1a_64(F.col("p_name").cast("binary")).alias("hash"))


@query()
def multiset_fold(t: Tables) -> DataFrame:
    """The fold that other builds compare; its second multiplier leaves the 128 bits of SQL, so tests hold it."""
    return aggregates.multiset_fold(t.part, ["p_size"], "p_brand")


@query("SELECT p_partkey, p_name AS text, CASE p_partkey % 2 WHEN 0 THEN 'hex -> utf8' ELSE 'base64 -> utf8' END AS path, 'high' AS confidence FROM part WHERE p_partkey % 2 = 0 OR regexp_matches(to_base64(encode(p_name)), '[0-9+/=]')")
def hidden_texts(t: Tables) -> DataFrame:
    """Names behind hexadecimal digits or base64, found again with the way to them."""
    coded = F.when(F.col("p_partkey") % 2 == 0, F.hex("p_name")).otherwise(F.base64(F.col("p_name").cast("binary")))
    found = t.part.select("p_partkey", F.explode(K.transduce(coded.cast("binary"))).alias("f"))
    return found.select("p_partkey", "f.text", "f.path", "f.confidence").where("confidence = 'high' AND path NOT LIKE '%->%->%'")


@query("SELECT p_partkey, p_name || chr(233) AS text FROM part")
def latin1_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.latin1(F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("E9")))).alias("text"))
