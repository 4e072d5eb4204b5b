"""Line dedup with DataFrame functions only.

Lines are exploded with their place, normalised and hashed to 128 bits; each hash gets its number of distinct documents
and the largest document id; lines over the threshold are marked in all other documents, and a document's lines are put
together again by place. Only hashes and places pass the shuffles of the lines. Counts are combined before each shuffle,
first by (hash, document) and then by hash, so a line that stands everywhere loads no single task. The joined side of
hot hashes is a written table: Spark broadcasts it under its own threshold and else joins by sorting, splitting skew.

Defined cases: a null or empty text is one empty line and never changes; a null key is no document, so it neither counts
nor keeps a line; rows that repeat a key are one document in the count and each keeps or loses lines alike; an empty
table gives an empty result. Other columns stay as they are, whatever their names. Equal largest keys tie as one document:
all its rows keep the line. A long text is split in place; only hashes and places of its lines move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import free_name, stage

#: The white space that is stripped from a line's ends.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the kept text, and at the end _n_lines and _n_dropped; names that are taken get underscores."""
    n_lines, n_dropped = free_name(docs, "_n_lines"), free_name(docs, "_n_dropped")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    split = own.select("row", F.col("row")[key].alias("id"), F.xxhash64(whole).alias("print"), F.split(whole, "\n", -1).alias("lines"))

    lines = split.select("id", "print", F.posexplode("lines").alias("place", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).select("id", "print", "place", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    lines = stage(lines.select("id", "print", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")), "lines")

    hot = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    hot = stage(hot.select("h1", "h2", "keeper"), "hot-lines")
    lost = lines.join(hot, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("id").alias("lost_id"), F.col("print").alias("lost_print")).agg(F.collect_set("place").alias("lost"))

    joined = split.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("print") == F.col("lost_print")), "left")
    kept_places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.array_join(F.transform(kept_places, lambda place: F.get("lines", place)), "\n")
    columns = [F.when(F.col("lost").isNull(), F.col("row")[c]).otherwise(kept).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*columns, F.size("lines").cast("long").alias(n_lines), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias(n_dropped))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.place, l.line, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
