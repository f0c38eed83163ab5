import random

import pytest

from datarill.engine import Engine, unique
from datarill.functions.domains import Domain, DomainTooLarge
from datarill.operators.fixpoint import NotConverged, Options
from datarill.operators.numbering import path_ranges
from datarill.plans.ast import ProgramError
from datarill.plans.parser import parse
from datarill.plans.validate import validate
from datarill.session import Session
from tests.reference_evaluator import evaluate


def solve(spark, text, out, **facts):
    e = Engine(spark, text)
    for name, rows in facts.items():
        e.bind(name, spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(len(e.relation_schema(name))))))
    return {tuple(r) for r in e.relation(out).collect()}


MICRO = [
    ("N 4\ne (a:N, b:N)\nr (a:N, b:N)\nr(a,b) :- e(a,b).\nr(a,c) :- r(a,b), e(b,c).", "r", {"e": [(0, 1), (1, 2), (2, 0)]}, {(a, b) for a in range(3) for b in range(3)}),
    ("N 4\np (x:N)\nq (x:N)\nd (x:N)\nd(x) :- p(x), !q(x).", "d", {"p": [(0,), (1,), (2,)], "q": [(1,)]}, {(0,), (2,)}),
    ("N 2\np (x:N)\nr (x:N, y:N)\nd (x:N)\nd(x) :- p(x), !r(x,_).", "d", {"p": [(0,), (1,)], "r": [(0, 0), (0, 1), (1, 0)]}, {(1,)}),
    ("N 2\nr (x:N, y:N)\nd (x:N)\nd(x) :- r(x,*).", "d", {"r": [(0, 0), (0, 1), (1, 0)]}, {(0,)}),
    ("N 4\np (x:N)\nd (x:N, y:N)\nd(x,_) :- p(x).", "d", {"p": [(2,)]}, {(2, y) for y in range(4)}),
    ("N 2\nr (x:N, y:N)\nd (x:N, y:N)\nd(x,y) :- !r(x,y).", "d", {"r": [(0, 0)]}, {(0, 1), (1, 0), (1, 1)}),
    ("N 4\np (x:N)\nd (x:N, y:N)\nd(x,y) :- p(x), p(y), x<y.", "d", {"p": [(0,), (1,), (2,)]}, {(0, 1), (0, 2), (1, 2)}),
    ("N 4\np (x:N)\nd (x:N, y:N)\nd(x,y) :- p(x), x=y.", "d", {"p": [(0,), (2,)]}, {(0, 0), (2, 2)}),
    ("N 4\nr (x:N, y:N)\nd (x:N, y:N)\nd(3,x) :- r(x,1).", "d", {"r": [(0, 1), (2, 0), (2, 1)]}, {(3, 0), (3, 2)}),
    ("N 4\np (x:N)\nd (x:N)\nd(x) :- !p(_), p(x).", "d", {"p": [(1,)]}, {(1,)}),
    ("N 2\np (x:N)\nr (x:N, y:N)\nd (x:N)\nd(x) :- p(x), !r(x,*).", "d", {"p": [(0,), (1,)], "r": [(1, 0)]}, {(0,)}),
]


@pytest.mark.parametrize("text, out, facts, expected", MICRO, ids=[str(i) for i in range(len(MICRO))])
def test_micro(spark, text, out, facts, expected):
    assert solve(spark, text, out, **facts) == expected


ERRORS = [
    ("N 4\nq (x:N) input\np (x:N)\np(x) :- q(x), !p(x).", "not stratifiable"),
    ("N 4\nu (x:N)\np (x:N) output\np(x) :- u(x).", "no input or fact"),
    ("N 4\nr (x:N, y:N) input\nd (x:N)\nd(x) :- r(x,x).", "stands twice"),
    ("N 4\nr (x:N, y:N) input\nd (x:N)\nd(x) :- r(x,y).", "used once"),
    ("N 4\nM 4\na (x:N) input\nb (x:M) input\nd (x:N)\nd(x) :- a(x), b(x).", "domains"),
    ("N 4\nd (x:N)\nd (x:N)", "declared already"),
    (".wrong", "unknown directive"),
    ("N 4\nd (x:N)\n!d(x) :- d(x).", "head"),
    (".strict\nN 4\np (x:N) input\nd(x) :- p(x).", "isn't declared"),
    ("N 4\np (x:N) input\nd (x:N) nonsense", "unknown relation option"),
    ("N 4\np (x:N) input\nd (x:N)\nd(x) :- p(x). nonsense", "unknown rule option"),
]


@pytest.mark.parametrize("text, message", ERRORS, ids=[m for _, m in ERRORS])
def test_errors(spark, text, message):
    with pytest.raises(ProgramError, match=message):
        Engine(spark, text).solve()


def test_parser_reads_every_form():
    p = parse(
        '# comment\n.bddvarorder N0_N1\n.basedir "x"\nN 8 names.map\n\nr (a : N0, b:N1) input printsize pri=3 a=b a<b { note }\ns (a:N) \\\n  output\n'
        's(a):-r(a,_),a!=3. split pri=-10 trace modifies (r,s) pre {one} post {two}\ns("na.me").\ns($x) :- r($x,*).\nr(a,b), s(b)? project b ;\ns(3) :- ? single\n'
    )
    assert p.relations["r"].options == {"input", "printsize"} and p.relations["r"].priority == 3 and p.relations["r"].hook == "note"
    assert p.rules[0].priority == -10 and p.rules[0].modifies == ["r", "s"] and p.rules[0].pre == ["one"] and p.rules[0].post == ["two"]
    assert [q.single for q in p.queries] == [False, True] and [v.name for v in p.queries[0].rule.head.args] == ["a"]
    assert len(p.rules) == 3 and p.domains["N"].map_file == "names.map"


def test_includes_and_inference(tmp_path, spark):
    (tmp_path / "base.inc").write_text("N 4\ne (a:N, b:N)\n")
    e = Engine(spark, '.include "base.inc"\nback(a,b) :- e(b,a).\nout (a:N)\nout(a) :- back(a,0).', include_dirs=[str(tmp_path)])
    assert e.program.relations["back"].attributes == [("a", "N"), ("b", "N")]
    assert {tuple(r) for r in e.bind("e", spark.createDataFrame([(0, 3)], "a long, b long")).relation("out").collect()} == {(3,)}


def test_single_gives_one_valid_tuple(spark):
    got = solve(spark, "N 8\np (x:N)\nd (x:N)\nd(x) :- p(x). single", "d", p=[(5,), (3,)])
    assert got == {(3,)}


def test_map_embeds_in_the_next_free_elements(spark):
    e = Engine(spark)
    e.domain("A", 2)
    e.domain("B", 8, ["x", "y", "z"])
    e.load("p (a:A)\nq (b:B)\nd (a:A, b:B)\nd(a,b) :- p(a), q(b), a => b.")
    e.bind("p", spark.createDataFrame([(0,), (1,)], "a long")).bind("q", spark.range(8).select("id"))
    assert {tuple(r) for r in e.relation("d").collect()} == {(0, 3), (1, 4)}


def test_named_constants_and_unknown_names(spark):
    e = Engine(spark)
    e.domain("N", 8, ["zero", "one"])
    e.load('p (a:N)\nd (a:N)\nd(a) :- p(a), a = "one".\nd("new").')
    e.bind("p", spark.createDataFrame([(0,), (1,)], "a long"))
    assert {tuple(r) for r in e.relation("d").collect()} == {(1,), (2,)}
    assert any("new" in w for w in e.program.warnings)


def test_enumeration_is_guarded(spark):
    with pytest.raises(DomainTooLarge):
        solve(spark, "N 2305843009213693952\np (x:N)\nd (x:N, y:N)\nd(x,_) :- p(x).", "d", p=[(2,)])


def test_iteration_limit(spark):
    e = Engine(spark, "N 64\ne (a:N, b:N)\nr (a:N, b:N)\nr(a,b) :- e(a,b).\nr(a,c) :- r(a,b), e(b,c).", options=Options(max_iterations=2))
    e.bind("e", spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long"))
    with pytest.raises(NotConverged):
        e.solve()


def test_inputs_are_sets_without_nulls_and_ints_become_long(spark):
    e = Engine(spark, "N 8\np (x:N)")
    e.bind("p", spark.createDataFrame([(1,), (1,), (None,)], "x int"))
    assert [tuple(r) for r in e.relation("p").collect()] == [(1,)] and dict(e.relation("p").dtypes) == {"x": "bigint"}


def test_empty_inputs_and_missing_files(spark, tmp_path):
    e = Engine(spark, f'.basedir "{tmp_path}/"\nN 8\np (x:N) inputtuples\nd (x:N) output\nd(x) :- p(x).')
    assert e.relation("d").count() == 0 and e.program.warnings
    with pytest.raises(OSError):
        Engine(spark, f'.basedir "{tmp_path}/"\nN 8\np (x:N) inputtuples\nd (x:N) output\nd(x) :- p(x).', strict_inputs=True).solve()


def test_add_tells_whether_it_changes(spark):
    e = Engine(spark, "N 8\np (x:N)")
    assert e.add("p", [(1,)]) and not e.add("p", [(1,)]) and e.contains("p", 0, 1) and not e.contains("p", 0, 2)
    assert e.matching("p", [1]).count() == 1 and e.column_values("p", 0).count() == 1


def random_program(r):
    """A small stratified program: base p, q; r recursive; s with negation above it."""
    lines = ["N 3", "p (x:N, y:N) input", "q (x:N) input", "r (x:N, y:N)", "s (x:N, y:N)", "t (x:N)"]
    v = lambda: r.choice(["x", "y"])
    lines += ["r(x,y) :- p(x,y)."]
    lines += [r.choice(["r(x,y) :- r(x,z), p(z,y).", "r(x,y) :- r(x,z), r(z,y).", "r(x,y) :- r(y,x), q(x).", "r(x,y) :- p(y,x), r(x,z), z != y.", f"r(x,y) :- r(x,_), q(y), {v()} <= 1."])]
    lines += [r.choice(["s(x,y) :- q(x), q(y), !r(x,y).", "s(x,y) :- !r(x,y), q(x).", "s(x,_) :- q(x), !r(x,*).", "s(x,y) :- r(x,y), !q(y), x < y.", "s(x,x2) :- r(x,_), x = x2.", "s(2,y) :- r(0,y)."])]
    lines += [r.choice(["t(x) :- s(x,*).", "t(x) :- q(x), !s(x,_).", "t(x) :- s(x,y), s(y,_).", "t(x) :- q(x), !s(_,x).", "t(1) :- s(_,_)."])]
    facts = {"p": {(r.randrange(3), r.randrange(3)) for _ in range(r.randrange(5))}, "q": {(r.randrange(3),) for _ in range(r.randrange(4))}}
    return "\n".join(lines), facts


@pytest.mark.parametrize("seed", range(8))
def test_random_programs_match_the_plain_evaluator(spark, seed):
    text, facts = random_program(random.Random(seed))
    for incremental in (True, False) if seed < 2 else (True,):
        e = Engine(spark, text, options=Options(incremental=incremental))
        for name, rows in facts.items():
            e.bind(name, spark.createDataFrame(sorted(rows), ", ".join(f"c{i} long" for i in range(2 if name == "p" else 1))))
        outs = ["r", "s", "t"]
        strata = e.strata(outs)
        expected = evaluate(validate(parse(text)), facts, strata)
        solved = e.solve(outs)
        for n in outs:
            assert {tuple(x) for x in solved[n].collect()} == expected.get(n, set()), (n, text, facts)


def test_numbering_invariants():
    edges = [(("a", 0), ("a", 1), 1), (("a", 0), ("a", 2), 1), (("a", 1), ("a", 3), 1), (("a", 2), ("a", 3), 1), (("a", 3), ("a", 4), 1), (("a", 4), ("a", 3), 1), (("a", 9), ("a", 4), 1)]
    paths, start = path_ranges([("a", 0)], edges)
    assert paths == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 2}
    assert {start[edges[2]], start[edges[3]]} == {(0, 1), (1, 1)}  # consecutive and apart
    assert start[edges[4]] == start[edges[5]] == (0, 2)  # the same inside a cycle
    assert edges[6] not in start  # unreachable


def test_provenance(spark):
    e = Engine(spark, "N 8\na (x:N, y:N)\nb (x:N, y:N)\nc (x:N, y:N)\nc(x,z) :- a(x,y), b(y,z).")
    e.bind("a", spark.createDataFrame([(0, 1), (1, 2)], "x long, y long")).bind("b", spark.createDataFrame([(1, 2), (2, 3)], "x long, y long"))
    found = e.query("c(0,z) :- ?")
    assert {tuple(r) for r in found["q_a"].collect()} == {(0, 1)} and {tuple(r) for r in found["q_b"].collect()} == {(1, 2)}
    assert {tuple(r) for r in e.query("a(x,y), b(y,z)? project y ;").collect()} == {(0, 2), (1, 3)}
    assert "q_a" not in e.program.relations


def test_session(spark, tmp_path):
    s = Session(spark, folder=str(tmp_path))
    for line in ("N 4", "e (a:N, b:N)", "e(0,1).", "e(1,2).", "r (a:N, b:N)", "r(a,b) :- e(a,b).", "r(a,c) :- r(a,b), e(b,c)."):
        assert s.run(line) == ""
    assert "Tuples in query: (2)" in s.run("r(0,x)?")
    assert s.run("rules").splitlines()[3] == "4: r(a,c) :- r(a,b), e(b,c)."
    assert s.run("deleterule 4") == "" and "(1)" in s.run("r(0,x)?")
    assert s.run("nonsense here").startswith("Invalid") and "deleterule 9" not in s.log
    assert s.run("save r") == "saved r" and spark.read.parquet(f"{tmp_path}/r.parquet").count() == 2
    assert s.run("dumplog").startswith("Log dumped") and s.run("exit") is None
    assert "relations" in s.run("help") and "e(a:N, b:N)" in s.run("relations")


def test_hooks_need_registration_and_modifies(spark):
    e = Engine(spark, "N 4\np (x:N)\nd (x:N)\nd(x) :- p(x). {missing}")
    e.bind("p", spark.createDataFrame([(1,)], "x long"))
    with pytest.raises(ProgramError, match="registered"):
        e.solve()


def test_labels_and_unique():
    assert Domain("N", 2, ["a"]).label(0) == "a(0)" and Domain("N", 2).label(1) == "1"
    assert unique(["type", "type", "Type"]) == ["type", "type_2", "Type_3"]
