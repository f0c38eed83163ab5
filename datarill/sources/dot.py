"""Graphs as DOT text: nodes reachable from roots over edge relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from datarill.functions.storage import read_shared, write_shared

#: Nodes, and edges, of a text at most; graph() gives larger ones as tables.
LIMIT = 100_000


@dataclass
class EdgeSpec:
    relation: str
    roots: str
    label: str | None = None
    places: tuple[int, int, int] = (0, 1, 2)  # source, sink, label


@dataclass
class Spec:
    edges: list[EdgeSpec] = field(default_factory=list)
    modifiers: list[tuple[str, ...]] = field(default_factory=list)
    output: str | None = None


def parse_spec(text: str) -> Spec:
    """Lines ``edge R roots S [label L(source,sink,label)]``, ``domain D attribute value``, ``default attribute value``, ``relation R attribute value``, ``output file``."""
    spec = Spec()
    for line in text.splitlines():
        words = line.replace(",", " ").replace("(", " ").replace(")", " ").split()
        if not words or words[0].startswith("#"):
            continue
        kind, *rest = words
        if kind == "edge" and len(rest) >= 3 and rest[1] == "roots":
            e = EdgeSpec(rest[0], rest[2])
            if len(rest) > 3:
                if rest[3] != "label" or sorted(rest[5:8]) != ["label", "sink", "source"]:
                    raise ValueError(f"can't read {line!r}")
                e.label, e.places = rest[4], tuple(rest[5:8].index(w) for w in ("source", "sink", "label"))
            spec.edges.append(e)
        elif kind in ("domain", "relation") and len(rest) == 3 or kind == "default" and len(rest) == 2:
            spec.modifiers.append((kind, *rest))
        elif kind == "output" and len(rest) == 1:
            spec.output = rest[0]
        else:
            raise ValueError(f"can't read {line!r}")
    return spec


def reachable(edges, roots):
    """nodes (n) reachable from roots (n) over edges (a, b), and the edges among them."""
    spark = edges.sparkSession
    edges = edges.select("a", "b").distinct()
    schema = roots.select("n").schema
    seen = [write_shared(roots.select("n").distinct(), "dot")]
    new = seen[0]
    while True:
        front = read_shared(spark, [new], schema)
        step = edges.join(front, edges["a"] == front["n"], "left_semi").select(F.col("b").alias("n")).distinct()
        new = write_shared(step.join(read_shared(spark, seen, schema), "n", "left_anti"), "dot")
        if read_shared(spark, [new], schema).isEmpty():
            break
        seen.append(new)
    nodes = read_shared(spark, seen, schema)
    return nodes, edges.join(nodes, edges["a"] == nodes["n"], "left_semi")


def graph(engine, spec: Spec):
    """nodes (n) and edges (a, b, label) of a specification."""
    nodes = edges = None
    for e in spec.edges:
        rel = engine.relation(e.relation).toDF("a", "b")
        found, used = reachable(rel, engine.relation(e.roots).toDF("n"))
        if e.label:
            names = engine.relation(e.label).columns
            source, sink, label = (names[i] for i in e.places)
            text = engine.relation(e.label).select(F.col(source).alias("a"), F.col(sink).alias("b"), F.col(label).cast("string").alias("l"))
            text = text.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("l")), ", ").alias("label"))
            used = used.join(text, ["a", "b"], "left")
        else:
            used = used.withColumn("label", F.lit(None).cast("string"))
        nodes = found if nodes is None else nodes.union(found)
        edges = used if edges is None else edges.unionByName(used)
    return nodes.distinct(), edges.distinct()


def _rows(df, what: str) -> list:
    found = df.limit(LIMIT + 1).collect()
    if len(found) > LIMIT:
        raise ValueError(f"a drawing of more than {LIMIT} {what} isn't made; graph() gives its tables")
    return found


def draw(engine, spec: Spec) -> str:
    """The graph as text; raises beyond LIMIT nodes, edges or rows of a relation that changes nodes."""
    nodes, edges = graph(engine, spec)
    domain = engine.label_map(spec.edges[0].relation)[0]
    shapes: dict = {}
    for kind, *rest in spec.modifiers:
        if kind == "relation":
            for r in _rows(engine.relation(rest[0]), f"rows of {rest[0]}"):
                shapes.setdefault(r[0], {})[rest[1]] = rest[2]
    everywhere = {m[1]: m[2] for m in spec.modifiers if m[0] == "default"}
    everywhere |= {m[2]: m[3] for m in spec.modifiers if m[0] == "domain" and domain is not None and m[1] == domain.name}
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'
    name = lambda v: domain.label(v) if domain else str(v)
    out = ["digraph {"]
    for r in _rows(nodes.orderBy("n"), "nodes"):
        attributes = {**everywhere, **shapes.get(r["n"], {})}
        out.append(f"  {quote(name(r['n']))}" + (" [" + ", ".join(f"{k}={v}" for k, v in attributes.items()) + "]" if attributes else "") + ";")
    for r in _rows(edges.orderBy("a", "b", "label"), "edges"):
        out.append(f"  {quote(name(r['a']))} -> {quote(name(r['b']))}" + (f" [label={quote(r['label'])}]" if r["label"] is not None else "") + ";")
    return "\n".join([*out, "}"]) + "\n"
