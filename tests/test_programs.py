"""Registered programs held against plain computations, and guards of outputs that could be too large."""

import pytest

from datarill import queries
from datarill.engine import Engine
from datarill.functions.domains import DomainTooLarge
from datarill.plans.ast import ProgramError
from datarill.plans.parser import parse
from datarill.plans.split import split_rules
from datarill.plans.validate import validate
from datarill.sources import dot

SMALL = "/root/testdata/sf0.001"


def test_points_to_matches_sets(spark):
    parts = [(r["p_partkey"], r["p_size"] % 3, int(r["p_brand"].lstrip("Brand#"))) for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()]
    points, heap, size = {(p, h) for p, _, h in parts}, set(), -1
    while size != len(points) + len(heap):
        size = len(points) + len(heap)
        of = {}
        for v, h in points:
            of.setdefault(v, set()).add(h)
        points |= {(p, h) for p, _, _ in parts for h in of.get(p // 2, ())}
        heap |= {(h, f, g) for p, f, _ in parts for h in of.get(p, ()) for g in of.get(p // 3, ())}
        fields = {}
        for h, f, g in heap:
            fields.setdefault((h, f), set()).add(g)
        points |= {(p // 5, g) for p, f, _ in parts for h in of.get(p, ()) for g in fields.get((h, f), ())}
    e = queries.points_to(spark, SMALL)
    assert {tuple(r) for r in e.relation("vP").collect()} == points and {tuple(r) for r in e.relation("hP").collect()} == heap


@pytest.mark.parametrize("name", ["path_numbering", "path_numbering_count", "update_old_values", "bddinfo_load", "map_include", "tuples_ranges", "neg_wildcard", "same_generation"])
def test_registered_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("supplier", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and want


def test_split_makes_relations_in_between(spark):
    text = "N 16\na (x:N, y:N)\nb (x:N, y:N)\nc (x:N, y:N)\nout (x:N, w:N)\nout(x,w) :- a(x,y), b(y,z), !c(x,z), c(z,w), x != w. split"
    program = parse(text)
    validate(program)
    rules = split_rules(program, program.rules)
    assert len(rules) == 2 and [n for n, _ in program.relations[rules[0].head.relation].attributes] == ["x", "z"]
    rows = {"a": [(0, 1), (1, 2), (2, 3)], "b": [(1, 2), (2, 3), (3, 1)], "c": [(2, 5), (3, 6), (1, 1), (0, 2)]}
    got = []
    for program_text in (text, text.replace(" split", "")):
        e = Engine(spark, program_text)
        for name, pairs in rows.items():
            e.bind(name, spark.createDataFrame(pairs, "x long, y long"))
        got.append({tuple(r) for r in e.relation("out").collect()})
    assert got[0] == got[1] == {(1, 6), (2, 1)}


def test_blocks_before_a_rule_may_add_rows(spark):
    def more(new, read):
        return {"extra": spark.createDataFrame([(7,)], "x long")}

    e = Engine(spark, hooks={"more": more})
    e.load("N 16\np (x:N)\nout (x:N)\nextra (x:N)\nout(x) :- p(x). modifies extra pre {more}\nout(x) :- extra(x).")
    e.bind("p", spark.createDataFrame([(1,)], "x long"))
    assert {r[0] for r in e.relation("extra").collect()} == {7}


def test_drawings_and_numbers_are_guarded(spark, monkeypatch):
    e = Engine(spark, "N 64\nedge (a:N, b:N)\nroot (a:N)\nroot(0).")
    e.bind("edge", spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long"))
    assert e.dot("edge edge roots root").count("->") == 5
    monkeypatch.setattr(dot, "LIMIT", 4)
    with pytest.raises(ValueError, match="more than 4"):
        e.dot("edge edge roots root")
    e = Engine(spark, "M 64\nI 128\nC 1099511627776\nroots (m:M)\nmI (m:M, i:I)\nIE (i:I, m:M)\nnum (i:I, m:M, x:C, y:C)\nnum(i,m,x,y) :- roots(m), mI(m,i), IE(i,m). number\nroots(0).")
    # Two sites lead from each method to the next: the paths double at each step.
    e.bind("mI", spark.createDataFrame([(k, 2 * k + j) for k in range(34) for j in (0, 1)], "m long, i long"))
    e.bind("IE", spark.createDataFrame([(2 * k + j, k + 1) for k in range(34) for j in (0, 1)], "i long, m long"))
    with pytest.raises((DomainTooLarge, ProgramError), match="path numbers"):
        e.relation("num")
