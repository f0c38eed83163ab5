"""URL rules as intervals over reversed-host keys, judged by a sorted sweep.

A rule (host, path) fits every url whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path. With the host
written as its reversed labels (``org.example.``) a host rule is an interval of
keys, and with the path behind it (``org.example.|/es/``) so is a rule with a
path. A url stands once under each of its own host suffixes that has a rule.
All starts and ends of intervals and all url keys of one suffix are sorted
together; prefix intervals never cross, so the active rules are a stack whose
top is the last rule that started and hasn't ended. Each end marker carries the
rule that the stack goes back to, so the top at a key is the last marker before
it: one window function, no join of all pairs.

Only DataFrame functions run here. A suffix with many urls is dealt over as many
salted copies as its size asks for, by an exchange on suffix and salt; its rules go
to each copy. Each distinct url is judged once; urls get their verdicts by an
equi-join that Spark may split. The table of suffixes is broadcast while there are
at most MAX_MARKS markers, else joined by a shuffle.

Defined results: null urls and urls without ``://`` have an empty host and path
and fit no rule; repeated rows stay repeated; an empty rule table gives every
url the default verdict; of rules with equal host and path the smallest verdict
in text order holds; rules with a null host or path fit nothing; an empty table
stays empty; columns of pages named like those added are replaced, others may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Urls of one suffix that share a window at most, unless the suffix has more rules than that.
ROWS_PER_SALT = 1024
#: Interval markers up to which their suffixes are broadcast.
MAX_MARKS = 100_000

#: The rules of the registered query (fixed values): host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*", 0)
    return _lower(host)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _markers(rules: DataFrame) -> DataFrame:
    """Start and end of each rule's interval: suffix, key, kind, top (the rule on top of the stack from here on)."""
    host = _lower(F.col("host"))
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        _reversed(host).alias("suffix"),
        F.col("path").alias("key"),
        F.struct(F.concat(host, F.col("path")).alias("rule"), F.col("verdict").alias("verdict")).alias("own"),
    )
    r = r.groupBy("suffix", "key").agg(F.min("own").alias("own"))
    # The enclosing rule: the longest proper prefix of the path that is itself a rule of the suffix.
    cut = r.select("suffix", "key", F.explode(F.sequence(F.lit(0), F.length("key") - 1)).alias("n")).where(F.length("key") > 0)
    up = (
        cut.select("suffix", "key", F.expr("substring(key, 1, n)").alias("outer"), "n")
        .join(r.select("suffix", F.col("key").alias("outer"), F.col("own").alias("parent")), ["suffix", "outer"])
        .groupBy("suffix", "key")
        .agg(F.max_by("parent", "n").alias("parent"))
    )
    r = r.join(up, ["suffix", "key"], "left")
    # Kind 0 closes, 1 opens, 2 is a url; the end of an interval is its prefix followed by the highest code point.
    ends = r.select("suffix", F.concat("key", F.lit("\U0010ffff")).alias("key"), F.lit(0).alias("kind"), (-F.length("key")).alias("depth"), F.struct(F.col("parent").alias("top")).alias("mark"))
    starts = r.select("suffix", "key", F.lit(1).alias("kind"), F.length("key").alias("depth"), F.struct(F.col("own").alias("top")).alias("mark"))
    return starts.unionByName(ends)


def sweep(keyed: DataFrame, marks: DataFrame, sizes: DataFrame) -> DataFrame:
    """url and mark of each row of keyed(suffix, url, key) that has a rule on top; sizes has the salts of each suffix."""
    mark = marks.schema["mark"].dataType
    urls = keyed.join(sizes, "suffix").select("suffix", F.pmod(F.xxhash64("url"), F.col("salts")).cast("int").alias("salt"), "key", F.lit(2).alias("kind"), F.lit(0).alias("depth"), "url", F.lit(None).cast(mark).alias("mark"))
    dealt = marks.join(sizes, "suffix").select("suffix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "kind", "depth", F.lit(None).cast("string").alias("url"), "mark")
    order = Window.partitionBy("suffix", "salt").orderBy("key", "kind", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = urls.unionByName(dealt).repartition("suffix", "salt")
    return both.withColumn("mark", F.last("mark", ignorenulls=True).over(order)).where((F.col("kind") == 2) & F.col("mark.top").isNotNull()).select("url", "mark")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", rows_per_salt: int = ROWS_PER_SALT, max_marks: int = MAX_MARKS) -> DataFrame:
    """Adds host, path, rule and verdict to pages(url, ...); rules has host, path and verdict.

    Of the rules that fit, the one with the longest host and path wins.
    """
    added = {"host", "path", "rule", "verdict"}
    rows = pages.select(F.col("url").alias("_u"), F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]).alias("_page"))
    marks = materialize(_markers(rules), "marks")
    small = F.broadcast if marks.count() <= max_marks else lambda x: x
    with_rules = marks.groupBy("suffix").agg(F.count(F.lit(1)).alias("marks"))
    urls = rows.select(F.col("_u").alias("url")).where(F.locate("://", F.col("url")) > 0).distinct()
    keyed = urls.select("url", path_of(F.col("url")).alias("key"), F.reverse(F.split(host_of(F.col("url")), r"\.")).alias("labels"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat(F.array_join(F.slice("labels", 1, i), "."), F.lit(".")))
    keyed = keyed.select("url", "key", F.explode(suffixes).alias("suffix")).join(small(with_rules.select("suffix")), "suffix", "left_semi")
    keyed = materialize(keyed, "urls")
    sizes = keyed.groupBy("suffix").agg(F.count(F.lit(1)).alias("urls")).join(small(with_rules), "suffix")
    sizes = materialize(sizes.select("suffix", F.ceil(F.col("urls") / F.greatest(F.col("marks"), F.lit(rows_per_salt))).cast("int").alias("salts")), "sizes")
    best = F.max(F.struct(F.length("mark.top.rule").alias("n"), F.col("mark.top.rule").alias("rule"), F.col("mark.top.verdict").alias("verdict")))
    # As a table of its own, so that the join below may be split where one url has many rows.
    found = materialize(sweep(keyed, marks, small(sizes)).groupBy("url").agg(best.alias("best")), "verdicts")
    return rows.join(found, F.col("_u") == F.col("url"), "left").select(
        "_page.*",
        host_of(F.col("_u")).alias("host"),
        path_of(F.col("_u")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for the url of every page: page_id, host, path, rule, verdict."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(host, path, verdict)")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", "verdict")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, position('://' IN url) AS pos0 FROM pages
), q AS (
  SELECT page_id, CASE WHEN pos0 > 0 THEN substr(url, pos0 + 3) ELSE '' END AS rest FROM p
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path
  FROM q
), r(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rverdict, 'allow') AS verdict
FROM m WHERE k = 1
"""
