"""Registered programs over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datarill.engine import Engine
from datarill.functions.storage import shared_dir
from datarill.operators.fixpoint import Options
from datarill.sources import bdd, dot, maps, tuples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bind(e: Engine, d: str) -> Engine:
    """Binds each declared relation with a known name to its columns of the tables."""
    t = lambda n: _table(e.spark, d, n)
    known = {
        "nation": lambda: t("nation").select("n_nationkey", "n_regionkey"),
        "nationname": lambda: t("nation").select("n_nationkey", "n_name"),
        "region": lambda: t("region").select("r_regionkey"),
        "customer": lambda: t("customer").select("c_custkey", "c_nationkey"),
        "segment": lambda: t("customer").select("c_custkey", "c_mktsegment"),
        "supplier": lambda: t("supplier").select("s_suppkey", "s_nationkey"),
        "orders": lambda: t("orders").select("o_orderkey", "o_custkey"),
        "status": lambda: t("orders").select("o_custkey", "o_orderstatus"),
        "priority": lambda: t("orders").select("o_custkey", "o_orderpriority"),
        "sold": lambda: t("lineitem").select("l_orderkey", "l_suppkey"),
        "item": lambda: t("lineitem").select("l_suppkey", "l_partkey"),
        "brand": lambda: t("part").select("p_partkey", "p_brand"),
        "turn": lambda: t("conversations").select("conv_id", "turn"),
    }
    for name, decl in e.program.relations.items():
        if name in known and not any(r.head.relation == name for r in e.program.rules):
            e.bind(name, known[name]())
    return e




def _engine(spark: SparkSession, d: str, text: str) -> Engine:
    e = Engine(spark)
    e.domain("K")
    e.domain("S")
    e.domain("N", 32)
    e.domain("R", 8)
    e.domain("P", 5, [])
    e.load(text)
    return _bind(e, d)


def _program(name: str, text: str, out: str, sql: str | None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _engine(spark, d, text).relation(out)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


#: Pairs of nations: a customer's and that of a supplier it bought from.
EDGE = """
nation (n:N, r:R)
customer (c:K, n:N)
supplier (s:K, n:N)
orders (o:K, c:K)
sold (o:K, s:K)
order_nation (o:K, n:N)
order_nation(o,n) :- orders(o,c), customer(c,n).
"""
#: A tree of all suppliers, so that recursion grows with the data: each stands under the one with half its number.
TREE_SQL = "edge AS (SELECT s_suppkey // 2 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey // 2 IN (SELECT s_suppkey FROM supplier) AND s_suppkey <> 0)"


def _tree(spark: SparkSession, d: str, text: str) -> Engine:
    """The program over the tree of suppliers: edge leads from above to below."""
    e = Engine(spark)
    e.domain("V", 1 << 30)
    e.load("edge (a:V, b:V)\n" + text)
    s = _table(spark, d, "supplier").select("s_suppkey")
    above = s.select(F.col("s_suppkey").alias("a"))
    below = s.where("s_suppkey <> 0").select(F.floor(F.col("s_suppkey") / 2).cast("long").alias("a"), "s_suppkey")
    return e.bind("edge", below.join(above, "a", "left_semi"))


def _graph(name: str, text: str, out: str, sql: str | None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _tree(spark, d, text).relation(out)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH RECURSIVE {TREE_SQL}, {sql}"


# ---- selection, projection, joins

_program("project_distinct", "nation (n:N, r:R)\nout (r:R)\nout(r) :- nation(_,r).", "out", "SELECT DISTINCT n_regionkey::BIGINT AS r FROM nation")
_program("select_const", 'segment (c:K, s:S)\nout (c:K)\nout(c) :- segment(c,"BUILDING").', "out", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
_program("head_const", "region (r:R)\nout (k:R, r:R)\nout(3,r) :- region(r).", "out", "SELECT DISTINCT 3::BIGINT AS k, r_regionkey::BIGINT AS r FROM region")
_program("facts", "out (a:R, b:R)\nout(1,2).\nout(2,3).\nout(1,2).", "out", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT), (2, 3)) t(a, b)")
_program("join_chain", "nation (n:N, r:R)\ncustomer (c:K, n:N)\nregion (r:R)\nout (c:K, r:R)\nout(c,r) :- customer(c,n), nation(n,r), region(r).", "out", "SELECT DISTINCT c_custkey AS c, r_regionkey::BIGINT AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_program("semi_join", "nation (n:N, r:R)\nsupplier (s:K, n:N)\nout (n:N, r:R)\nout(n,r) :- nation(n,r), supplier(_,n).", "out", "SELECT DISTINCT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
_program("cross_product", "region (r:R)\nout (a:R, b:R)\nout(a,b) :- region(a), region(b).", "out", "SELECT DISTINCT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b FROM region a CROSS JOIN region b")
for _name, _op, _sql in (("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">="), ("ne", "!=", "<>"), ("eq", "=", "=")):
    _program(f"self_join_{_name}", f"supplier (s:K, n:N)\nout (a:K, b:K)\nout(a,b) :- supplier(a,n), supplier(b,n), a {_op} b.", "out", f"SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey {_sql} b.s_suppkey")
_program("compare_const", "supplier (s:K, n:N)\nout (a:K, n:N)\nout(a,n) :- supplier(a,n), n >= 3, n != 7.", "out", "SELECT DISTINCT s_suppkey AS a, s_nationkey::BIGINT AS n FROM supplier WHERE s_nationkey >= 3 AND s_nationkey <> 7")
_program("equal_binds", "region (r:R)\nout (a:R, b:R)\nout(a,b) :- region(a), a = b.", "out", "SELECT DISTINCT r_regionkey::BIGINT AS a, r_regionkey::BIGINT AS b FROM region")
_program("multi_type", "status (c:K, s:S)\nout (c:K)\nout(c) :- status(c,a), status(c,b), a != b.", "out", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
_program("part_supplier_join", "item (s:K, p:K)\nbrand (p:K, b:S)\nsupplier (s:K, n:N)\nout (n:N, b:S)\nout(n,b) :- item(s,p), brand(p,b), supplier(s,n).", "out", "SELECT DISTINCT s_nationkey::BIGINT AS n, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
_program("trade_pairs", EDGE + "out (a:N, b:N)\nout(a,b) :- order_nation(o,a), sold(o,s), supplier(s,b).", "out", "SELECT DISTINCT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey")

# ---- set operations, negation, quantifiers

_program("union_rules", "customer (c:K, n:N)\nsupplier (s:K, n:N)\nout (n:N)\nout(n) :- customer(_,n).\nout(n) :- supplier(_,n).", "out", "SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey FROM supplier")
_program("intersect", "customer (c:K, n:N)\nsupplier (s:K, n:N)\nout (n:N)\nout(n) :- customer(_,n), supplier(_,n).", "out", "SELECT c_nationkey::BIGINT AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_program("difference", 'status (c:K, s:S)\npart_done (c:K)\nout (c:K)\npart_done(c) :- status(c,"P").\nout(c) :- status(c,_), !part_done(c).', "out", "SELECT o_custkey AS c FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
_program("anti_join", 'customer (c:K, n:N)\npriority (c:K, s:S)\nurgent (c:K)\nout (c:K)\nurgent(c) :- priority(c,"1-URGENT").\nout(c) :- customer(c,_), !urgent(c).', "out", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")


def _priorities(spark: SparkSession, d: str, text: str) -> Engine:
    """The program over pri(c,p): the priorities 0 to 4 of each customer's orders."""
    e = Engine(spark)
    e.domain("K")
    e.domain("P", 5)
    e.load("pri (c:K, p:P)\n" + text)
    return e.bind("pri", _table(spark, d, "orders").select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("p")))


QUERIES["neg_wildcard"] = lambda s, d: _priorities(s, d, "out (c:K)\nout(c) :- pri(c,_), !pri(c,_).").relation("out")
SQL["neg_wildcard"] = "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) < 5"


QUERIES["forall_division"] = lambda s, d: _priorities(s, d, "out (c:K)\nout(c) :- pri(c,*).").relation("out")
SQL["forall_division"] = "SELECT o_custkey AS c FROM orders WHERE substr(o_orderpriority, 1, 1) BETWEEN '1' AND '5' GROUP BY 1 HAVING count(DISTINCT substr(o_orderpriority, 1, 1)) = 5"

_program("unbound_head", "region (r:R)\nout (r:R, x:R)\nout(r,_) :- region(r).", "out", "SELECT DISTINCT r_regionkey::BIGINT AS r, x::BIGINT AS x FROM region CROSS JOIN range(8) t(x)")
_program("complement_pairs", "nation (n:N, r:R)\nout (n:N, r:R)\nout(n,r) :- !nation(n,r).", "out", "SELECT n::BIGINT AS n, r::BIGINT AS r FROM range(32) a(n) CROSS JOIN range(8) b(r) EXCEPT SELECT n_nationkey, n_regionkey FROM nation")
_program("partly_bound_negation", "nation (n:N, r:R)\nregion (r:R)\nout (n:N, r:R)\nout(n,r) :- region(r), !nation(n,r).", "out", "SELECT n::BIGINT AS n, r_regionkey::BIGINT AS r FROM range(32) a(n) CROSS JOIN region EXCEPT SELECT n_nationkey, n_regionkey FROM nation")

# ---- recursion

_REACH = "reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)"
_graph("tc_linear", "reach (a:V, b:V)\nreach(a,b) :- edge(a,b).\nreach(a,c) :- reach(a,b), edge(b,c).", "reach", f"{_REACH} SELECT * FROM reach")
_graph("tc_nonlinear", "reach (a:V, b:V)\nreach(a,b) :- edge(a,b).\nreach(a,c) :- reach(a,b), reach(b,c).", "reach", f"{_REACH} SELECT * FROM reach")
_graph("reach_from_root", "from (b:V)\nfrom(b) :- edge(0,b).\nfrom(c) :- from(b), edge(b,c).", "from", "f(b) AS (SELECT b FROM edge WHERE a = 0 UNION SELECT e.b FROM f JOIN edge e ON f.b = e.a) SELECT * FROM f")
_graph("mutual_even_odd", "odd (a:V, b:V)\neven (a:V, b:V)\nodd(a,b) :- edge(a,b).\nodd(a,c) :- even(a,b), edge(b,c).\neven(a,c) :- odd(a,b), edge(b,c).", "even", "w(a, b, p) AS (SELECT a, b, 1 FROM edge UNION SELECT w.a, e.b, 1 - p FROM w JOIN edge e ON w.b = e.a) SELECT a, b FROM w WHERE p = 0")
_graph("same_generation", "sg (a:V, b:V)\nsg(a,b) :- edge(p,a), edge(p,b).\nsg(a,b) :- edge(p,a), sg(p,q), edge(q,b).", "sg", "sg(a, b) AS (SELECT x.b, y.b FROM edge x JOIN edge y ON x.a = y.a UNION SELECT x.b, y.b FROM sg JOIN edge x ON x.a = sg.a JOIN edge y ON y.a = sg.b) SELECT * FROM sg")
_graph("unreachable_pairs", "node (n:V)\nnode(a) :- edge(a,_).\nnode(b) :- edge(_,b).\nreach (a:V, b:V)\nreach(a,b) :- edge(a,b).\nreach(a,c) :- reach(a,b), edge(b,c).\nout (a:V, b:V)\nout(a,b) :- node(a), node(b), !reach(a,b).", "out", f"{_REACH}, node AS (SELECT a AS n FROM edge UNION SELECT b FROM edge) SELECT x.n AS a, y.n AS b FROM node x CROSS JOIN node y EXCEPT SELECT a, b FROM reach")
_graph("strata_chain", "reach (b:V)\nreach(b) :- edge(0,b).\nreach(c) :- reach(b), edge(b,c).\nlost (a:V)\nlost(a) :- edge(a,_), !reach(a).\nsafe (a:V)\nsafe(a) :- edge(a,b), !lost(a), b != 1.", "safe", "f(b) AS (SELECT b FROM edge WHERE a = 0 UNION SELECT e.b FROM f JOIN edge e ON f.b = e.a) SELECT DISTINCT a FROM edge WHERE a IN (SELECT b FROM f) AND b <> 1")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.domain("K")
    e.load("next (c:K, a:K, b:K)\nafter (c:K, a:K, b:K)\nafter(c,x,y) :- next(c,x,y).\nafter(c,x,z) :- after(c,x,y), next(c,y,z).")
    t = _table(spark, d, "conversations").select("conv_id", "turn").distinct()
    e.bind("next", t.alias("x").join(t.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.turn") + 1 == F.col("y.turn"))).select(F.col("x.conv_id").alias("c"), F.col("x.turn").alias("a"), F.col("y.turn").alias("b")))
    return e.relation("after")


QUERIES["turn_chain"] = _turns
SQL["turn_chain"] = "WITH RECURSIVE n AS (SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn), t(c, a, b) AS (SELECT c, a, b FROM n UNION SELECT t.c, t.a, n.b FROM t JOIN n ON t.c = n.c AND t.b = n.a) SELECT * FROM t"


POINTS_TO = """
vP0 (v:K, h:K)
A0 (d:K, s:K)
S (b:K, f:K, s:K)
L (b:K, f:K, d:K)
vP (v:K, h:K)
hP (h:K, f:K, g:K)
vP(v,h) :- vP0(v,h).
vP(v,h) :- A0(v,w), vP(w,h).
hP(h,f,g) :- S(v,f,w), vP(v,h), vP(w,g).
vP(w,g) :- L(v,f,w), vP(v,h), hP(h,f,g).
"""


def points_to(spark: SparkSession, d: str) -> Engine:
    """A points-to program over relations made from all parts: variables are parts, objects are brands, fields are sizes by three."""
    e = Engine(spark)
    e.domain("K")
    e.load(POINTS_TO)
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("p"), (F.col("p_size") % 3).cast("long").alias("f"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("h"))
    below = lambda k: F.floor(F.col("p") / k).cast("long")
    e.bind("vP0", p.select("p", "h"))
    e.bind("A0", p.select("p", below(2).alias("s")))
    e.bind("S", p.select("p", "f", below(3).alias("s")))
    e.bind("L", p.select("p", "f", below(5).alias("d")))
    return e


QUERIES["points_to_mini"] = lambda spark, d: points_to(spark, d).relation("vP")
#: Rounds over both relations in one table with all its rows at hand: kind 0 is vP, 1 is hP.
SQL["points_to_mini"] = """
WITH RECURSIVE p AS (SELECT p_partkey AS p, (p_size % 3)::BIGINT AS f, regexp_extract(p_brand, '[0-9]+')::BIGINT AS h FROM part),
t(k, a, f, b) USING KEY (k, a, f, b) AS (
  SELECT 0, p, 0::BIGINT, h FROM p
  UNION
  (WITH v AS (SELECT a, b FROM recurring.t WHERE k = 0), hp AS (SELECT a, f, b FROM recurring.t WHERE k = 1), fresh AS (SELECT count(*) AS n FROM t)
  SELECT * FROM (
    SELECT 0, p.p, 0, v.b FROM p JOIN v ON v.a = p.p // 2
    UNION SELECT 1, x.b, p.f, y.b FROM p JOIN v x ON x.a = p.p JOIN v y ON y.a = p.p // 3
    UNION SELECT 0, p.p // 5, 0, hp.b FROM p JOIN v ON v.a = p.p JOIN hp ON hp.a = v.b AND hp.f = p.f
    EXCEPT SELECT k, a, f, b FROM recurring.t) WHERE (SELECT n FROM fresh) > 0)
)
SELECT a AS v, b AS h FROM t WHERE k = 0
"""

# ---- options

_program("split_rule", "nation (n:N, r:R)\ncustomer (c:K, n:N)\nregion (r:R)\nout (c:K, r:R)\nout(c,r) :- customer(c,n), nation(n,r), region(r). split", "out", SQL["join_chain"])
_program("single_pick", "supplier (s:K, n:N)\nout (s:K, n:N)\nout(s,n) :- supplier(s,n). single", "out", "SELECT s_suppkey AS s, s_nationkey::BIGINT AS n FROM supplier ORDER BY 1, 2 LIMIT 1")
_program("inferred_relation", "supplier (s:K, n:N)\nnation (n:N, r:R)\nplace(s,r) :- supplier(s,n), nation(n,r).\nout (s:K)\nout(s) :- place(s,1).", "out", "SELECT DISTINCT s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")


#: Suppliers as methods: each is called by those with a half and a third of its number, at sites of its own.
CALLS_SQL = "WITH RECURSIVE c0 AS (SELECT s_suppkey // 2 AS a, 2 * s_suppkey AS i, s_suppkey AS b FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey // 3, 2 * s_suppkey + 1, s_suppkey FROM supplier WHERE s_suppkey > 0 AND s_suppkey // 3 <> s_suppkey // 2), w(node) AS (SELECT 0::BIGINT UNION ALL SELECT b FROM w JOIN c0 ON node = a), c AS (SELECT i, b AS m, count(*) AS n FROM w JOIN c0 ON node = a GROUP BY 1, 2)"


def _numbered(spark: SparkSession, d: str) -> Engine:
    """Numbers of the call paths from supplier 0, at each site and at the method it calls."""
    e = Engine(spark)
    e.domain("M", 1 << 30)
    e.domain("I", 1 << 31)
    e.domain("C", 1 << 40)
    e.load("roots (m:M)\nmI (m:M, i:I)\nIE (i:I, m:M)\nIEnum (i:I, m:M, x:C, y:C)\nIEnum(i,m,x,y) :- roots(m), mI(m,i), IE(i,m). number\nroots(0).")
    s = _table(spark, d, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("m"))
    by = lambda k: F.floor(F.col("m") / k).cast("long")
    calls = s.select(by(2).alias("a"), (F.col("m") * 2).alias("i"), "m").union(s.where(by(3) != by(2)).select(by(3), F.col("m") * 2 + 1, "m"))
    return e.bind("mI", calls.select("a", "i")).bind("IE", calls.select("i", "m"))


QUERIES["path_numbering"] = lambda spark, d: _numbered(spark, d).relation("IEnum")
SQL["path_numbering"] = f"{CALLS_SQL}, s AS (SELECT i, m, n, coalesce(sum(n) OVER (PARTITION BY m ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM c) SELECT i, m, x::BIGINT AS x, (x + shift)::BIGINT AS y FROM (SELECT i, m, shift, unnest(range(n)) AS x FROM s)"


def _numbering_count(spark: SparkSession, d: str) -> DataFrame:
    """Paths into each method and their numbers, from the ranges that the operator gives each call; overlaps count once."""
    r = _numbered(spark, d).ranges("IEnum").withColumn("end", F.col("n") + F.col("shift"))
    before = F.coalesce(F.max("end").over(Window.partitionBy("m").orderBy("shift", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("fresh", F.greatest(F.col("end") - F.greatest("shift", before), F.lit(0)))
    return r.groupBy("m").agg(F.sum("n").alias("paths"), F.sum("fresh").alias("numbers"), F.min("shift").alias("first"), (F.max("end") - 1).alias("last"))


QUERIES["path_numbering_count"] = _numbering_count
SQL["path_numbering_count"] = f"{CALLS_SQL} SELECT m, sum(n)::BIGINT AS paths, sum(n)::BIGINT AS numbers, 0::BIGINT AS first, (sum(n) - 1)::BIGINT AS last FROM c GROUP BY 1"


def _domain_map(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.domain("R", 5, [f"r{i}" for i in range(5)])
    e.domain("N", 64, [f"n{i}" for i in range(25)])
    e.load("region (r:R)\nout (r:R, n:N)\nout(r,n) :- region(r), r => n.")
    return e.bind("region", _table(spark, d, "region").select("r_regionkey")).relation("out")


QUERIES["domain_map"] = _domain_map
SQL["domain_map"] = "SELECT r_regionkey::BIGINT AS r, r_regionkey::BIGINT + 25 AS n FROM region"


# ---- queries, provenance, outputs

QUERIES["query_conjunctive"] = lambda s, d: _engine(s, d, "supplier (s:K, n:N)\nnation (n:N, r:R)").query("supplier(s,n), nation(n,r)?")
SQL["query_conjunctive"] = "SELECT DISTINCT s_suppkey AS s, n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey"
QUERIES["query_project"] = lambda s, d: _engine(s, d, "supplier (s:K, n:N)\nnation (n:N, r:R)").query("supplier(s,n), nation(n,r)? project n s ;")
SQL["query_project"] = "SELECT DISTINCT n_regionkey::BIGINT AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d, "supplier (s:K, n:N)\nnation (n:N, r:R)\nplace (s:K, r:R)\nplace(s,r) :- supplier(s,n), nation(n,r).")
    found = e.query("place(_,1) :- ?")
    return found["q_nation"].toDF("n", "r")


QUERIES["provenance"] = _provenance
SQL["provenance"] = "SELECT DISTINCT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d, "supplier (s:K, n:N) printsize\nnation (n:N, r:R) printsize\nplace (s:K, r:R) printsize\nplace(s,r) :- supplier(s,n), nation(n,r).").sizes()


QUERIES["relation_sizes"] = _sizes
SQL["relation_sizes"] = "SELECT 'supplier' AS relation, count(DISTINCT (s_suppkey, s_nationkey))::BIGINT AS size FROM supplier UNION ALL SELECT 'nation', count(DISTINCT (n_nationkey, n_regionkey)) FROM nation UNION ALL SELECT 'place', count(DISTINCT (s_suppkey, n_regionkey)) FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/datarill-tuples-{uuid.uuid4().hex}"
    tuples.write_tuples(_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r")), path, [("N", 32), ("R", 8)])
    return tuples.read_tuples(spark, path, [32, 8]).toDF("n", "r")


QUERIES["tuples_roundtrip"] = _roundtrip
SQL["tuples_roundtrip"] = "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation"


def _dot(spark: SparkSession, d: str) -> DataFrame:
    e = _tree(spark, d, "root (a:V)\nroot(1).")
    _, edges = dot.graph(e, dot.parse_spec("edge edge roots root"))
    return edges.select("a", "b")


QUERIES["dot_reachable"] = _dot
SQL["dot_reachable"] = f"WITH RECURSIVE {TREE_SQL}, f(b) AS (SELECT 1::BIGINT UNION SELECT e.b FROM f JOIN edge e ON f.b = e.a) SELECT a, b FROM edge WHERE a IN (SELECT b FROM f)"


def _hook(spark: SparkSession, d: str) -> DataFrame:
    """Facts on demand: each region that turns up brings its nations in between rounds."""
    t = _table(spark, d, "nation").select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"))

    def fetch(new: DataFrame, read) -> dict[str, DataFrame]:
        return {"known": t.join(new.toDF("r"), t["n_regionkey"] == F.col("r"), "left_semi")}

    e = Engine(spark, hooks={"fetch": fetch})
    e.domain("N", 32)
    e.domain("R", 8)
    e.load("seen (r:R)\nknown (r:R, n:N)\nhop (r:R, s:R)\nseen(s) :- seen(r), hop(r,s). modifies known {fetch}\nseen(0).")
    e.bind("hop", spark.createDataFrame([(0, 1), (1, 2)], "r long, s long"))
    return e.relation("known")


QUERIES["hook_facts"] = _hook
SQL["hook_facts"] = "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey IN (0, 1, 2)"
QUERIES["pattern_scan"] = lambda s, d: _engine(s, d, "nation (n:N, r:R)").matching("nation", [None, 1])
SQL["pattern_scan"] = "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation WHERE n_regionkey = 1"
QUERIES["invert"] = lambda s, d: _engine(s, d, "nation (n:N, r:R)").invert("nation")
SQL["invert"] = SQL["complement_pairs"]
QUERIES["flagship_trade_reach"] = lambda s, d: _engine(s, d, EDGE + "edge (a:N, b:N)\nedge(a,b) :- order_nation(o,a), sold(o,t), supplier(t,b).\nreach (a:N, b:N)\nreach(a,b) :- edge(a,b).\nreach(a,c) :- reach(a,b), edge(b,c).").relation("reach")
SQL["flagship_trade_reach"] = f"WITH RECURSIVE edge AS ({SQL['trade_pairs']}), {_REACH} SELECT * FROM reach"

# ---- files, sessions of changes, modes

_PAIRS_SQL = "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation"


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/datarill-files-{uuid.uuid4().hex}"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))


def _local(make: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose files the driver alone reads and writes, in a folder that it removes; the result is on the driver by then."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        import tempfile

        with tempfile.TemporaryDirectory() as folder:
            df = make(spark, d, folder)
            return spark.createDataFrame([tuple(r) for r in df.collect()], df.schema)

    return run


def _bdd(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """The relation of nations and regions, written as a diagram and loaded by its declaration."""
    bdd.write_bdd([tuple(r) for r in _pairs(spark, d).collect()], f"{folder}/pair.bdd", [("N", 32), ("R", 8)])
    e = Engine(spark)
    e.program.basedir = folder
    e.load("N 32\nR 8\npair (n:N, r:R) input\nout (n:N, r:R)\nout(n,r) :- pair(n,r).")
    return e.relation("out")


QUERIES["bdd_load"] = _local(_bdd)
SQL["bdd_load"] = _PAIRS_SQL


def _bddinfo(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """The same from a diagram without a header, its variables placed by bddinfo."""
    bdd.write_bdd([tuple(r) for r in _pairs(spark, d).collect()], f"{folder}/full.bdd", [("N", 32), ("R", 8)])
    with open(f"{folder}/full.bdd", encoding="ascii") as whole, open(f"{folder}/pair.bdd", "w", encoding="ascii") as bare, open(f"{folder}/bddinfo", "w", encoding="ascii") as info:
        bare.writelines(line for line in whole if not line.startswith("#"))
        info.write("N\nR\n")
    e = Engine(spark)
    e.program.basedir = folder
    e.load("N 32\nR 8\npair (n:N, r:R) input\nout (n:N, r:R)\nout(n,r) :- pair(n,r).")
    return e.relation("out")


QUERIES["bddinfo_load"] = _local(_bddinfo)
SQL["bddinfo_load"] = _PAIRS_SQL


def _include(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """A program that includes another, with names of a domain from a map file."""
    with open(f"{folder}/names.map", "w", encoding="utf-8") as file:
        file.writelines(r["n_name"] + "\n" for r in _table(spark, d, "nation").orderBy("n_nationkey").collect())
    with open(f"{folder}/more.datalog", "w", encoding="utf-8") as file:
        file.write("R 8\npair (n:N, r:R)\n")
    e = Engine(spark)
    e.program.basedir = folder
    e.parser.include_dirs = [folder]
    e.load('N 32 names.map\n.include "more.datalog"\nout (r:R)\nout(r) :- pair("NATION_7",r).')
    return e.bind("pair", _pairs(spark, d)).relation("out")


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """An output written by save() and read again; a save hook runs once."""
    folder, ran = _folder(spark), []
    e = _engine(spark, d, "nation (n:N, r:R)\nout (n:N, r:R) output\nout(n,r) :- nation(n,r).")
    e.save_hooks.append(lambda engine: ran.append(engine))
    e.save(folder)
    return spark.read.parquet(f"{folder}/out.parquet").withColumn("hooks", F.lit(len(ran)).cast("long"))


QUERIES["output_saved"] = _saved
SQL["output_saved"] = "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r, 1::BIGINT AS hooks FROM nation"


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """A tuple file with a range and a star."""
    path = _folder(spark)
    spark.createDataFrame([("# N0:5 R0:3",), ("3-5 1",), ("",), ("7 *",)], "value string").coalesce(1).write.text(path)
    return tuples.read_tuples(spark, path, [32, 8]).toDF("n", "r")


QUERIES["tuples_ranges"] = _ranges
SQL["tuples_ranges"] = "SELECT n::BIGINT AS n, 1::BIGINT AS r FROM range(3, 6) t(n) UNION ALL SELECT 7, r FROM range(8) t(r)"


def _printed(spark: SparkSession, d: str) -> DataFrame:
    text = _engine(spark, d, "nation (n:N, r:R)").show("nation").split("\n")
    return spark.createDataFrame([(i, line) for i, line in enumerate(text)], "i long, line string")


QUERIES["printed_tuples"] = _printed
SQL["printed_tuples"] = "SELECT 0::BIGINT AS i, 'Tuples in nation: (' || count(*) || ')' AS line FROM nation UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey, n_regionkey), '(n=' || n_nationkey || ',r=' || n_regionkey || ')' FROM nation"


def _added(spark: SparkSession, d: str) -> DataFrame:
    """Tuples added to a bound relation after it was solved once."""
    e = _engine(spark, d, "nation (n:N, r:R)\nout (n:N)\nout(n) :- nation(n,1).")
    e.relation("out").count()
    e.add("nation", [(30, 1), (31, 1), (30, 1)])
    return e.relation("out")


QUERIES["added_tuples"] = _added
SQL["added_tuples"] = "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey = 1 UNION SELECT 30 UNION SELECT 31"
QUERIES["column_values"] = lambda s, d: _engine(s, d, "nation (n:N, r:R)").column_values("nation", 1)
SQL["column_values"] = "SELECT DISTINCT n_regionkey::BIGINT AS r FROM nation"


def _empty(spark: SparkSession, d: str) -> DataFrame:
    """A rule over a bound relation without rows adds nothing."""
    e = _engine(spark, d, "nothing (n:N)\nnation (n:N, r:R)\nout (n:N)\nout(n) :- nation(n,_), nothing(n).\nout(n) :- nation(n,0).")
    return e.bind("nothing", spark.createDataFrame([], "n long")).relation("out")


QUERIES["empty_relation"] = _empty
SQL["empty_relation"] = "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey = 0"
_program("constant_index", 'big (n:N)\nnation (n:N, r:R)\nbig(n) :- nation(n,3).\nout (n:N)\nout(n) :- nation(n,r), big(n), r != 2. pri=3', "out", "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey = 3")


def _naive(spark: SparkSession, d: str) -> DataFrame:
    """tc_linear with every round over whole relations."""
    e = _tree(spark, d, "reach (a:V, b:V)\nreach(a,b) :- edge(a,b).\nreach(a,c) :- reach(a,b), edge(b,c).")
    e.options = Options(incremental=False)
    return e.relation("reach")


QUERIES["tc_naive"] = _naive
SQL["tc_naive"] = SQL["tc_linear"]


def _old_values(spark: SparkSession, d: str) -> DataFrame:
    """An update block that is given the rows before the new ones: at each round, how many were known."""

    def note(new: DataFrame, read, old: DataFrame) -> dict[str, DataFrame]:
        return {"note": spark.createDataFrame([(old.count(), new.count())], "a long, b long")}

    e = Engine(spark, hooks={"note": note})
    e.domain("N", 32)
    e.domain("R", 8)
    e.load("hop (a:R, b:R)\nnote (a:N, b:N)\nseen (r:R) {note}\nseen(0).\nseen(s) :- seen(r), hop(r,s). modifies note")
    e.bind("hop", _table(spark, d, "region").select("r_regionkey", (F.col("r_regionkey") + 1).alias("b")).where("b < 5"))
    return e.relation("note")


def _come_from(spark: SparkSession, d: str) -> DataFrame:
    """All relations that a derived tuple comes from, with their names."""
    e = _engine(spark, d, "supplier (s:K, n:N)\nnation (n:N, r:R)\nplace (s:K, r:R)\nplace(s,r) :- supplier(s,n), nation(n,r).")
    found = e.query("place(_,1) :- ?")
    return found["q_nation"].toDF("a", "b").withColumn("relation", F.lit("nation")).union(found["q_supplier"].toDF("a", "b").withColumn("relation", F.lit("supplier")))


QUERIES["provenance_relations"] = _come_from
SQL["provenance_relations"] = "SELECT DISTINCT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b, 'nation' AS relation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"
QUERIES["map_include"] = _local(_include)
SQL["map_include"] = "SELECT n_regionkey::BIGINT AS r FROM nation WHERE n_nationkey = 7"
QUERIES["update_old_values"] = _old_values
SQL["update_old_values"] = "SELECT x::BIGINT AS a, 1::BIGINT AS b FROM range(5) t(x)"


def _maps(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Diagrams that map nations and regions into one target, loaded as relations."""
    sizes = [("N", _table(spark, d, "nation").count()), ("R", _table(spark, d, "region").count())]
    maps.write_maps(folder, ("T", 64), sizes)
    e = Engine(spark)
    e.program.basedir = folder
    e.load("N 32\nR 8\nT 64\nmap_N_T (n:N, t:T) input\nmap_R_T (r:R, t:T) input\nall (t:T)\nall(t) :- map_N_T(_,t).\nall(t) :- map_R_T(_,t).")
    return e.relation("all")


QUERIES["map_builder"] = _local(_maps)
SQL["map_builder"] = "SELECT t::BIGINT AS t FROM range((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 2) x(t)"


def _number_graph(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Lines of the drawing of the numbered call graph, by kind."""
    e = _numbered(spark, d)
    e.options = Options(number_graph=folder)
    e.ranges("IEnum")
    edges = nodes = 0
    with open(f"{folder}/IEnum.dot", encoding="utf-8") as file:
        for x in file:
            edges += "->" in x
            nodes += "[label" in x and "->" not in x
    return spark.createDataFrame([("edges", edges), ("nodes", nodes)], "kind string, n long")


QUERIES["number_graph"] = _local(_number_graph)
SQL["number_graph"] = f"{CALLS_SQL} SELECT 'edges' AS kind, 2 * count(*) AS n FROM c UNION ALL SELECT 'nodes', count(*) + (SELECT count(*) FROM supplier) FROM c"
