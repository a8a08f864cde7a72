"""Line deduplication by distinct-site spread, with DataFrame functions only.

A HyperLogLog sketch of sites is built for each line hash and merged by aggregation. Lines whose estimate is far
from the threshold are decided by it; those near it get an exact distinct count. A line on min_sites sites or more
is boilerplate: it stays in the document with the least id that has it and goes from all others.

Defined results: lines are the \\n-split parts with a character other than ASCII white space, compared exactly;
others never go. Null sites count as no site. Null texts stay null, empty ones empty; a null id counts as the
greatest. Repeated rows of the least id all keep their line. Very long texts and lines are split and hashed whole. An
empty table gives an empty table. Column names of the input cannot clash with those used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

MIN_SITES, LG_K = 10, 12
#: Parts of a line's rows in a join with lines by hash: no task meets all rows of a very common line.
SALTS = 32
#: Estimates within so many standard errors of the threshold are counted exactly.
NEAR = 6 * 1.04 / 2 ** (LG_K / 2)


def _lines(text):
    return F.split(text, "\n", -1)


def _joined(lines: DataFrame, some: DataFrame, how: str = "inner") -> DataFrame:
    """lines with the rows of some by line hash; some is repeated for each salt, lines are many times as many."""
    salt = F.pmod(F.xxhash64("id", "site"), F.lit(SALTS))
    spread = some.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return lines.withColumn("salt", salt).join(spread, ["a", "b", "salt"], how).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """a, b (line hash), keeper of each line on min_sites distinct sites or more; lines: a, b, site, id."""
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("id").alias("keeper"))
    margin = max(1.0, NEAR * min_sites)
    spread = cut(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    sure = spread.where(F.col("sites") > min_sites + margin).select("a", "b", "keeper")
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = _joined(lines.where("site is not null"), near.select("a", "b"), "left_semi").select("a", "b", "site").distinct()
    exact = exact.groupBy("a", "b").count().where(F.col("count") >= min_sites).select("a", "b")
    return sure.unionByName(near.join(exact, ["a", "b"]).select("a", "b", "keeper"))


def removals(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """id, print (text hash), gone (a flag for each line): the documents that lose lines."""
    parts = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.xxhash64(text_col).alias("print"), F.posexplode(_lines(F.col(text_col))).alias("at", "line"))
    lines = parts.select("id", "site", "print", "at", F.when(F.col("line").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("line")).alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    lines = cut(lines.where("a is not null"), "lines")
    common = boilerplate(lines, min_sites)
    hit = _joined(lines, common).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return hit.groupBy("id", "print").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", length_col: str = "n_chars", min_sites: int = MIN_SITES, count_col: str | None = None) -> DataFrame:
    """docs with the lines gone, all rows and columns kept; count_col adds how many went. length_col follows the text."""
    i, p, g, parts = (free_name(docs.columns, n) for n in ("_id", "_print", "_gone", "_parts"))
    gone = removals(docs, id_col, text_col, site_col, min_sites).select(F.col("id").alias(i), F.col("print").alias(p), F.col("gone").alias(g))
    text = F.col(text_col)
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(p)), "left")
    # the explode of one array keeps the split from being worked out again for each line
    joined = joined.withColumn(parts, F.explode(F.array(F.when(F.col(g).isNotNull(), _lines(text)))))
    starts, ends = F.concat(F.array(F.lit(0)), F.transform(g, lambda x: x + 1)), F.concat(g, F.array(F.size(parts)))
    runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))), lambda x: x["n"] > 0)
    left = F.array_join(F.flatten(F.transform(runs, lambda x: F.slice(parts, x["at"] + 1, x["n"]))), "\n")
    joined = joined.withColumn(parts + "2", F.when(F.col(g).isNull(), text).otherwise(left))
    columns = [F.col(parts + "2").alias(c) if c == text_col else F.when(F.col(g).isNull(), F.col(c)).otherwise(F.length(parts + "2")).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(F.size(g), F.lit(0)).cast("long").alias(count_col)] if count_col else []))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per row: id, n_lines (with a word, before), n_removed, clean_chars, clean_sha256 (null for null text)."""
    own = docs.select(F.col(id_col), F.col(site_col), F.col(text_col), F.coalesce(F.size(F.filter(_lines(F.col(text_col)), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long").alias("_n"))
    out = remove_boilerplate(own, id_col, text_col, site_col, min_sites=min_sites, count_col="n_removed")
    return out.select(F.col(id_col), F.greatest(F.col("_n"), F.lit(0)).alias("n_lines"), "n_removed", F.length(text_col).cast("long").alias("clean_chars"), F.sha2(F.col(text_col), 256).alias("clean_sha256"))


def report_sql(min_sites: int) -> str:
    """line_report(docs, min_sites=min_sites) in SQL."""
    return f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), w AS (
  SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), b AS (
  SELECT line, min(doc_id) AS keeper FROM w GROUP BY line HAVING count(DISTINCT source) >= {min_sites}
), m AS (
  SELECT l.doc_id, l.line, l.pos, regexp_matches(l.line, '[^\\x20\\x09-\\x0D]') AS has_word, b.line IS NOT NULL AND b.keeper <> l.doc_id AS gone
  FROM l LEFT JOIN b ON l.line = b.line
), g AS (
  SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(g.clean) END::BIGINT AS clean_chars,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(g.clean) END AS clean_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
