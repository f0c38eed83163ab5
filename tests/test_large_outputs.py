"""Rules whose output is far larger than their input: right rows, and plans in which no pair is shuffled."""

from pyspark.sql import functions as F

from datarill.engine import Engine
from datarill.operators.fixpoint import Options


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_product_without_a_relation(spark):
    text = "N 512\nnode (n:N)\nr (a:N, b:N)\nout (a:N, b:N)\nout(a,b) :- node(a), node(b), !r(a,b), a != b."
    pairs = [(a, b) for a in range(200) for b in range(200) if a == 3 or (a * 7 + b) % 5 == 0]
    e = Engine(spark, text)
    e.bind("node", spark.range(200)).bind("r", spark.createDataFrame(pairs, "a long, b long"))
    out = e.relation("out")
    want = {(a, b) for a in range(200) for b in range(200) if a != b} - set(pairs)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Before, all pairs came from one nested loop and were dealt anew to drop copies.
    assert "NestedLoop" not in _plan(out) and "CartesianProduct" not in _plan(out)


def _doubling(spark, steps: int, options: Options | None = None) -> Engine:
    """Two sites lead from each method to the next, so the paths double at each step."""
    e = Engine(spark, "M 64\nI 128\nC 1099511627776\nroots (m:M)\nmI (m:M, i:I)\nIE (i:I, m:M)\nnum (i:I, m:M, x:C, y:C)\nnum(i,m,x,y) :- roots(m), mI(m,i), IE(i,m). number\nroots(0).", options=options)
    e.bind("mI", spark.createDataFrame([(k, 2 * k + j) for k in range(steps) for j in (0, 1)], "m long, i long"))
    return e.bind("IE", spark.createDataFrame([(2 * k + j, k + 1) for k in range(steps) for j in (0, 1)], "i long, m long"))


def test_many_path_numbers_are_made_by_the_tasks(spark):
    # 33 million numbers: beyond the former bound of 10 million.
    n = _doubling(spark, 24).relation("num")
    got = n.groupBy("i").agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.sum("x"), F.max(F.col("y") - F.col("x"))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {2 * k + j: (2**k, 0, 2**k - 1, j * 2**k, (j + 1) * 2**k - 1, 2**k * (2**k - 1) // 2, j * 2**k) for k in range(24) for j in (0, 1)}


def test_ranges_of_numbers_need_no_numbers(spark):
    got = {tuple(r) for r in _doubling(spark, 34).ranges("num").collect()}
    assert got == {(2 * k + j, k + 1, 2**k, j * 2**k) for k in range(34) for j in (0, 1)}


def test_graphs_are_drawn_without_their_numbers(spark, tmp_path):
    _doubling(spark, 34, Options(number_graph=str(tmp_path))).ranges("num")
    lines = (tmp_path / "num.dot").read_text().splitlines()
    assert lines[0] == "digraph {" and lines[-1] == "}" and sum("->" in x for x in lines) == 136
    assert '  "m 34" [label="m 34: 0..17179869183"];' in lines


def test_self_joins_deal_blocks_and_drop_copies(spark):
    # Element 7 has several keys, so its pairs come up more than once; key 0 has more rows than a block.
    rows = [(s, s % 3 if s < 900 else 0) for s in range(1000)] + [(7, 0), (7, 2), (8, 1)]
    of = {}
    for s, n in rows:
        of.setdefault(n, set()).add(s)
    for op, test in (("<", int.__lt__), (">=", int.__ge__), ("!=", int.__ne__)):
        e = Engine(spark, f"K 2048\nN 8\ns (s:K, n:N)\nout (a:K, b:K)\nout(a,b) :- s(a,n), s(b,n), a {op} b.")
        out = e.bind("s", spark.createDataFrame(rows, "s long, n long")).relation("out")
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for v in of.values() for a in v for b in v if test(a, b)}
    # Before, all pairs of a key came from one join and were aggregated.
    assert "explode(_rows" in _plan(out)


def test_self_joins_of_several_columns(spark):
    rows = [(x, x % 4, x % 2, x % 3) for x in range(40)] + [(1, 1, 0, 0), (1, 1, 1, 2)]
    e = Engine(spark, "K 64\nt (a:K, b:K, m:K, n:K)\nout (a:K, b:K, c:K, d:K)\nout(d,a,c,b) :- t(a,b,m,n), t(c,d,m,n).")
    out = e.bind("t", spark.createDataFrame(rows, "a long, b long, m long, n long")).relation("out")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(y[1], x[0], y[0], x[1]) for x in rows for y in rows if x[2:] == y[2:]}
