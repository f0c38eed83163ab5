"""Quality rules with thresholds that adapt to each language and source.

Every text is measured inside its own row by built-in functions. Four measures are
logarithms of rates with half an event added, so that they vary where most counts
are zero: symbols a word, marks a character, repeated lines a line, and words a
distinct word. Mergeable quantile summaries (percentile_approx: partial summaries
merge in any order) give the lower quartile and the median of each measure per
language and source, per language, and of all; a group of fewer than OWN texts takes
those of its language, and a language of fewer those of all, as so few set no
limits of their own. A text is rejected if a measure lies further above the median than
its FENCES times the distance from the lower quartile to the median; there are no
fixed cutoffs. RESOLUTION, the least distance, only matters in groups of nearly
equal texts, and a text without any symbol, mark or repetition isn't rejected for it. Only the lower half of a group sets its spread, so
a group with much junk doesn't lift its own limits. The limits are joined back to
the texts, by a broadcast while there are at most MAX_GROUPS of them, else by a
join that Spark may split.

Only DataFrame functions run here. The measures are written once to the shared
folder, as both the summaries and the join read them; texts don't move. The driver
gets the quantiles of all texts, one row.

Defined results: null and blank texts have no words and fail the base rule;
null languages or sources are groups of their own; repeated rows stay repeated;
groups in which no text passes the base rule set no limits; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Measure: how many times the distance from the lower quartile to the median a text may lie above the median.
FENCES = {"symbol_log": 8.0, "mark_log": 8.0, "dup_log": 4.0, "repeat_log": 8.0}
#: Texts that pass the base rule, from which on a group or a language has limits of its own.
OWN = 20
#: What a text must have to be rejected by a measure.
EVENTS = {"symbol_log": "n_symbols > 0", "mark_log": "n_marks > 0", "dup_log": "n_dup_lines > 0", "repeat_log": "n_words > n_distinct"}
#: The least distance from the lower quartile to the median, as a share of a rate.
RESOLUTION = 0.02
#: Groups whose limits are broadcast, at most.
MAX_GROUPS = 100_000
#: One over the rank error of the quantile summaries.
ACCURACY = 10000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Adds the base measures and the logarithms to df, whose columns must not start with ``_q``.

    Windows of eight words are compared by 64-bit hashes of their words' hashes,
    within one text only.
    """
    text = text_of() if text is None else text
    has_word = lambda x: F.length(F.regexp_replace(x, r"\A[\x09-\x0D\x20]+", "")) > 0
    keep = [F.col(f"`{c}`") for c in df.columns]
    one = df.select(
        *keep,
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_q_words"),
        F.filter(F.split(text, "\n"), has_word).alias("_q_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\p{M}\x20\x09-\x0D]")).cast("long").alias("n_marks"),
    )
    kept = [*keep, F.col("n_symbols"), F.col("n_marks")]
    two = one.select(
        *kept,
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_hashes"),
    )
    kept += [F.col(c) for c in ("n_words", "word_chars", "_q_n_lines", "n_dup_lines")]
    three = two.select(
        *kept,
        F.size(F.array_distinct("_q_hashes")).cast("long").alias("n_distinct"),
        F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_q_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_q_hashes", i, WINDOW)))).alias("_q_windows"),
    )
    kept.append(F.col("n_distinct"))
    four = three.select(
        *kept,
        F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
            F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_q_sorted"),
    )
    same = lambda j: F.get("_q_sorted", j)["h"]
    five = four.select(
        *kept,
        F.array_sort(F.transform(F.filter("_q_sorted", lambda x, j: F.coalesce(x["h"] == same(j - 1), F.lit(False)) | F.coalesce(x["h"] == same(j + 1), F.lit(False))), lambda x: x["i"])).alias("_q_at"),
    )
    covered = F.aggregate(
        F.transform("_q_at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_at", j + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    log = lambda a, b: F.log((F.col(a) + 0.5) / (F.col(b) + 1.0))
    return five.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_marks",
        "n_distinct",
        log("n_symbols", "n_words").alias("symbol_log"),
        log("n_marks", "word_chars").alias("mark_log"),
        log("n_dup_lines", "_q_n_lines").alias("dup_log"),
        F.when(F.col("n_words") > 0, F.log(F.col("n_words") / F.col("n_distinct"))).otherwise(F.lit(0.0)).alias("repeat_log"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def thresholds(measured: DataFrame, lang: str, source: str, accuracy: int = ACCURACY) -> DataFrame:
    """Limits of each measure per group, over the rows that pass the base rule: _g0 (language), _g1 (source), and limit_<measure>."""
    cut = [F.percentile_approx(m, [0.25, 0.5], accuracy).alias(m) for m in FENCES]
    passed = measured.where(~base_failed()).select(F.col(lang).alias("_g0"), F.col(source).alias("_g1"), *FENCES)
    # Sketches of groups merge to those of languages and of all.
    found = materialize(passed.rollup("_g0", "_g1").agg(F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("n"), *cut), "summaries")
    whole = found.where("_level = 3").first()
    of_all = {m: F.lit([float(x) for x in whole[m]] if whole else None).cast("array<double>") for m in FENCES}
    own = lambda m, up: F.when(F.col("n") >= OWN, F.col(m)).otherwise(up)
    languages = found.where("_level = 1").select(F.col("_g0").alias("_l0"), *[own(m, of_all[m]).alias(f"_l_{m}") for m in FENCES])
    groups = found.where("_level = 0").join(languages, F.col("_g0").eqNullSafe(F.col("_l0")))
    groups = groups.select("_g0", "_g1", *[own(m, F.col(f"_l_{m}")).alias(m) for m in FENCES])
    return groups.select("_g0", "_g1", *[(F.col(m)[1] + fence * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(RESOLUTION))).alias(f"limit_{m}") for m, fence in FENCES.items()])


def with_verdict(measured: DataFrame, lang: str, source: str, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Adds base_failed and kept; measured is read twice, so hand in a table."""
    limits = materialize(thresholds(measured, lang, source), "limits")
    if limits.count() <= max_groups:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("_g0")) & F.col(source).eqNullSafe(F.col("_g1")), "left")
    above = F.lit(False)
    for m, event in EVENTS.items():
        above = above | F.coalesce(F.expr(event) & (F.col(m) > F.col(f"limit_{m}")), F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns], base_failed().alias("base_failed"), (~base_failed() & ~above).alias("kept"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, the logarithms, base_failed and kept of every row of docs(doc_id, text, lang, source, ...)."""
    narrow = measure(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return with_verdict(materialize(narrow, "quality"), "lang", "source")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    Rows and their measures are written once; the summaries read the measures'
    columns only. Whatever docs' columns are named, they stay inside a struct.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_doc"))
    rows = rows.select("_q_doc", F.col("_q_doc.lang").alias("_q_lang"), F.col("_q_doc.source").alias("_q_source"))
    measured = materialize(measure(rows, text_of(F.col("_q_doc.text"))), "quality")
    return with_verdict(measured, "_q_lang", "_q_source").where("kept").select("_q_doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d WHERE len(words) >= 8)
), dup AS (
  SELECT w.doc_id, w.i FROM w JOIN (SELECT doc_id, win FROM w GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, win)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM dup) GROUP BY 1
), m AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '[^\p{L}\p{N}\p{M}\x20\x09-\x0D]')) AS marks, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct
  FROM d LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    ln((n_symbols + 0.5::DOUBLE) / (n_words + 1.0::DOUBLE)) AS s, ln((marks + 0.5::DOUBLE) / (word_chars + 1.0::DOUBLE)) AS k,
    ln((n_dup_lines + 0.5::DOUBLE) / (n_lines + 1.0::DOUBLE)) AS d, CASE WHEN n_words > 0 THEN ln(n_words::DOUBLE / n_distinct) ELSE 0.0 END::DOUBLE AS w
  FROM m
), p AS (SELECT * FROM r WHERE NOT base_failed
), a AS (
  SELECT quantile_disc(s, [0.25, 0.5]) AS s, quantile_disc(k, [0.25, 0.5]) AS k, quantile_disc(d, [0.25, 0.5]) AS d, quantile_disc(w, [0.25, 0.5]) AS w FROM p
), l AS (
  SELECT lang, count(*) >= 20 AS own, quantile_disc(s, [0.25, 0.5]) AS s, quantile_disc(k, [0.25, 0.5]) AS k, quantile_disc(d, [0.25, 0.5]) AS d, quantile_disc(w, [0.25, 0.5]) AS w FROM p GROUP BY 1
), g0 AS (
  SELECT lang, source, count(*) >= 20 AS own, quantile_disc(s, [0.25, 0.5]) AS s, quantile_disc(k, [0.25, 0.5]) AS k, quantile_disc(d, [0.25, 0.5]) AS d, quantile_disc(w, [0.25, 0.5]) AS w FROM p GROUP BY 1, 2
), g AS (
  SELECT g0.lang, source,
    CASE WHEN g0.own THEN g0.s WHEN l.own THEN l.s ELSE a.s END AS s, CASE WHEN g0.own THEN g0.k WHEN l.own THEN l.k ELSE a.k END AS k,
    CASE WHEN g0.own THEN g0.d WHEN l.own THEN l.d ELSE a.d END AS d, CASE WHEN g0.own THEN g0.w WHEN l.own THEN l.w ELSE a.w END AS w
  FROM g0 JOIN l ON g0.lang IS NOT DISTINCT FROM l.lang, a
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT coalesce(n_symbols > 0 AND r.s > g.s[2] + 8.0::DOUBLE * greatest(g.s[2] - g.s[1], 0.02::DOUBLE), false)
  AND NOT coalesce(marks > 0 AND r.k > g.k[2] + 8.0::DOUBLE * greatest(g.k[2] - g.k[1], 0.02::DOUBLE), false)
  AND NOT coalesce(n_dup_lines > 0 AND r.d > g.d[2] + 4.0::DOUBLE * greatest(g.d[2] - g.d[1], 0.02::DOUBLE), false)
  AND NOT coalesce(n_words > n_distinct AND r.w > g.w[2] + 8.0::DOUBLE * greatest(g.w[2] - g.w[1], 0.02::DOUBLE), false) AS kept
FROM r LEFT JOIN g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
"""
