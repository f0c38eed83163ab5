import os

import pytest

from datarill.engine import Engine
from datarill.sources import bdd, dot, maps, tuples


def rows(df):
    return {tuple(r) for r in df.collect()}


def lines(folder):
    out = []
    for f in sorted(os.listdir(folder)):
        if f.startswith("part-"):
            out += open(os.path.join(folder, f)).read().splitlines()
    return out


def test_tuples_fields(spark, tmp_path):
    (tmp_path / "a.tuples").write_text("# N0:3 M0:2\n1 2\n\n0-1 *\n# note\n5 0-1\n")
    got = rows(tuples.read_tuples(spark, str(tmp_path / "a.tuples"), [8, 4]))
    assert got == {(1, 2)} | {(a, b) for a in (0, 1) for b in range(4)} | {(5, 0), (5, 1)}


def test_tuples_without_header_and_bad_fields(spark, tmp_path):
    (tmp_path / "a.tuples").write_text("1 2\n3 0\n")
    assert rows(tuples.read_tuples(spark, str(tmp_path / "a.tuples"), [8, 4])) == {(1, 2), (3, 0)}
    (tmp_path / "b.tuples").write_text("1 x\n")
    with pytest.raises(Exception, match="not a tuple field"):
        tuples.read_tuples(spark, str(tmp_path / "b.tuples"), [8, 4]).collect()
    with pytest.raises(FileNotFoundError):
        tuples.read_tuples(spark, str(tmp_path / "none.tuples"), [8])


@pytest.mark.parametrize("given", [[(1, 2), (0, 3)], [], [(a, b) for a in range(4) for b in range(4)]], ids=["some", "empty", "all"])
def test_tuples_round_trip(spark, tmp_path, given):
    df = spark.createDataFrame(given, "a long, b long")
    path = str(tmp_path / "r.tuples")
    tuples.write_tuples(df, path, [("N", 4), ("N", 4)])
    text = lines(path)
    if not given:
        assert text == []
    else:
        assert text[0] == "# N0:2 N1:2"
        if len(given) == 16:
            assert text[1:] == ["* *"]
    assert rows(tuples.read_tuples(spark, path, [4, 4])) == set(given)


@pytest.mark.parametrize("given", [[(1, 2), (0, 3), (7, 0)], [], [(a, b) for a in range(8) for b in range(4)]], ids=["some", "empty", "all"])
def test_bdd_round_trip(spark, tmp_path, given):
    path = str(tmp_path / "r.bdd")
    bdd.write_bdd(given, path, [("N", 8), ("M", 4)])
    assert rows(bdd.read_bdd(spark, path, ["N", "M"], {"N": 8, "M": 4})) == set(given)


def test_bdd_without_header_uses_the_allocation(spark, tmp_path):
    (tmp_path / "bddinfo").write_text("N\nM\nN\n")
    assert bdd.layout(["N", "M", "N"], {"N": 8, "M": 4}) == {"N0": [0, 1, 2], "M0": [3, 4], "N1": [5, 6, 7]}
    # One node: bit 0 of the first N is set.
    (tmp_path / "r.bdd").write_text("1 8\n0 1 2 3 4 5 6 7\n2 0 0 1\n")
    assert rows(bdd.read_bdd(spark, str(tmp_path / "r.bdd"), ["N"], {"N": 8, "M": 4}, str(tmp_path / "bddinfo"))) == {(1,), (3,), (5,), (7,)}


def test_maps(tmp_path, spark):
    (tmp_path / "n.map").write_text("zero\none\n")
    assert maps.read_map(spark, str(tmp_path / "n.map")) == ["zero", "one"]
    assert maps.embedding([("A", 3), ("B", 2)]) == {"A": (0, 3), "B": (3, 5)}
    assert maps.embedding([("A", 3), ("B", 2)], inclusive=True) == {"A": (0, 4), "B": (4, 7)}


def test_program_with_files_outputs_and_dot(spark, tmp_path):
    (tmp_path / "n.map").write_text("zero\none\ntwo\nthree\n")
    (tmp_path / "e.tuples").write_text("0 1\n1 2\n3 0\n")
    (tmp_path / "g.spec").write_text("edge e roots root label l(source,sink,label)\ndefault color red\nrelation root shape box\noutput g.dot\n")
    text = f'.basedir "{tmp_path}/"\n.dot g.spec\nN 4 n.map\ne (a:N, b:N) inputtuples printtuples\nroot (a:N)\nroot(0).\nl (a:N, b:N, c:N)\nl(a,b,c) :- e(a,b), a = c.\nr (a:N, b:N) output outputtuples printsize\nr(a,b) :- e(a,b).\nr(a,c) :- r(a,b), e(b,c).\nr(3,x)?\n'
    e = Engine(spark, text)
    said = "\n".join(e.save(str(tmp_path)))
    assert "SIZE OF r: 6" in said and "(a=zero(0),b=one(1))" in said and "query@" in said
    assert spark.read.parquet(str(tmp_path / "r.parquet")).count() == 6
    assert len(lines(tmp_path / "r.tuples")) == 7
    drawn = (tmp_path / "g.dot").read_text()
    assert '"zero(0)" -> "one(1)" [label="0"];' in drawn and "three" not in drawn and "shape=box" in drawn


def test_bad_dot_specification():
    with pytest.raises(ValueError):
        dot.parse_spec("circle x")


def test_printing_stops_at_a_hundred(spark):
    e = Engine(spark, "N 128\np (x:N)")
    e.bind("p", spark.range(120).select("id"))
    text = e.show("p").splitlines()
    assert text[0] == "Tuples in p: (120)" and len(text) == 102 and text[-1] == "and more (120 in total)"
