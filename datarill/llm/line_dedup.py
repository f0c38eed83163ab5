"""Cross-site line dedup by the spread of each line over distinct sites.

A line's spread is the number of distinct sites that have it. HyperLogLog
sketches of the sites per line hash are made before the shuffle and merged
behind it, so a line that a third of all texts share moves one sketch per task.
A line whose estimate is near its threshold gets its exact count: its
(line, site) pairs are deduplicated and counted. Long lines, which don't repeat by
chance, have a lower threshold than short ones. A line at or above its threshold
is boilerplate; it stays where it stands first (smallest doc_id, then position)
and goes everywhere else.

Only DataFrame functions run here. Lines go by two 64-bit hashes of their text;
the text itself is not shuffled until the join that rebuilds it. Candidates and
boilerplate lines are sent to the lines while there are at most MAX_LINES of them,
else joined by a shuffle that Spark may split.

Defined results: null texts stay null and have no lines; lines without a word
are never removed; a null site is one site; repeated rows (same doc_id and text)
are treated alike; texts without any removed line come back unchanged; a text
that loses all its lines becomes empty but its row stays; empty tables give
empty tables; columns named n_removed in any case are replaced, others may have any
name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, table

#: A line of at least this many words is long.
LONG_WORDS = 8
#: Distinct sites from which on a line is boilerplate, for short and for long lines.
SHORT_SITES = 6
LONG_SITES = 2
#: log2 of the sketches' registers, and the estimates' distance from the threshold, as a share of it, within which sites are counted exactly.
LG_K = 9
NEAR = 0.25
#: Lines whose hashes are broadcast, at most.
MAX_LINES = 200_000


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row per line with a word: key (a, b), site, doc id, hash of the text, position, long."""
    lines = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("body"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    word = r"[^\x20\x09-\x0D]+"
    return lines.where(F.col("line").rlike(word)).select(
        "id",
        "body",
        "site",
        "pos",
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(1), "line").alias("b"),
        (F.regexp_count("line", F.lit(word)) >= LONG_WORDS).alias("long"),
    )


def boilerplate(lines: DataFrame, short_sites: int = SHORT_SITES, long_sites: int = LONG_SITES, max_lines: int = MAX_LINES) -> DataFrame:
    """a, b, sites and first (doc id, body, position) of each boilerplate line."""
    limit = F.when(F.col("long"), F.lit(long_sites)).otherwise(F.lit(short_sites))
    found = lines.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("long").alias("long"),
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"),
        F.min(F.struct("id", "body", "pos")).alias("first"),
    )
    # A line can't stand on more sites than it has occurrences.
    found = materialize(found.where((F.col("n") >= limit) & (F.col("estimate") >= limit * (1 - NEAR) - 0.5)), "lines")
    near = F.abs(F.col("estimate") - limit) <= F.greatest(limit * NEAR, F.lit(1.0))
    candidates = found.where(near).select("a", "b")
    # Down to the candidates first, then to one row per line and site in each task, before anything moves.
    pairs = lines.join(_sent(candidates, max_lines), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.count(F.lit(1)).alias("_"))
    exact = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("exact"))
    return (
        found.join(exact, ["a", "b"], "left")
        .withColumn("sites", F.coalesce("exact", "estimate"))
        .where(F.col("sites") >= limit)
        .select("a", "b", "sites", "n", "first")
    )


def _sent(lines: DataFrame, most: int) -> DataFrame:
    """lines, marked for a broadcast if there are at most so many."""
    return F.broadcast(lines) if lines.count() <= most else lines


def removals(docs: DataFrame, site: str = "source", short_sites: int = SHORT_SITES, long_sites: int = LONG_SITES, max_lines: int = MAX_LINES) -> DataFrame:
    """id, body and the sorted positions of the lines to remove from each text that loses any."""
    lines = materialize(line_table(docs, site), "spread")
    # As a table of its own, so that the join below may be split where one line has many rows.
    bad = materialize(boilerplate(lines, short_sites, long_sites, max_lines), "boilerplate")
    hit = lines.join(_sent(bad.select("a", "b", "first"), max_lines), ["a", "b"])
    same = F.col("first").eqNullSafe(F.struct("id", "body", "pos"))
    gone = materialize(hit.where(~same).groupBy("id", "body").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "removals")
    for done in (lines, bad):  # nothing reads them any more
        remove(done)
    return gone


def dedup_lines(docs: DataFrame, site: str = "source", short_sites: int = SHORT_SITES, long_sites: int = LONG_SITES, max_lines: int = MAX_LINES) -> DataFrame:
    """docs(doc_id, text, site, ...) with boilerplate lines removed from text, and ``n_removed``."""
    gone = removals(docs, site, short_sites, long_sites, max_lines)
    # Whatever docs' columns are named, they stay inside a struct.
    others = [c for c in docs.columns if c.lower() != "n_removed"]
    rows = docs.select(F.col("doc_id").alias("_i"), F.col("text").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in others if c.lower() != "text"]).alias("_doc"))
    joined = rows.join(gone, F.col("_i").eqNullSafe(F.col("id")) & (F.xxhash64("_t") == F.col("body")), "left")
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("_t", "\n")))
    # By position: array_except on integers works by hashing, so a text of many lines takes linear time.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    kept = [text.alias(c) if c.lower() == "text" else F.col("_doc").getField(c).alias(c) for c in others]
    return joined.select(*kept, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without boilerplate lines and n_removed of every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_removed")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l
), s AS (
  SELECT line, min((doc_id, pos)) AS first FROM w WHERE n > 0 GROUP BY line
  HAVING count(DISTINCT coalesce(source, '')) >= CASE WHEN any_value(n) >= 8 THEN 2 ELSE 6 END
), k AS (
  SELECT w.doc_id, w.pos, w.line, s.line IS NOT NULL AND s.first <> (w.doc_id, w.pos) AS gone
  FROM w LEFT JOIN s ON w.line = s.line
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (NOT k.gone), '') END AS text,
  count(*) FILTER (k.gone)::BIGINT AS n_removed
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.text
"""
