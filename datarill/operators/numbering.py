"""Path numbering: consecutive numbers for all paths from roots over an acyclic collapse of a graph.

The first body term of a ``number`` rule is the set of roots, the others are edge
relations; nodes are (variable, element). Strongly connected nodes count as one.
Every root starts with one path; a component has as many paths as come in over
all edges into it from other components, plus its roots. Incoming edges, sorted
by (term, source, target), take consecutive ranges. The head's first variables
are those of the numbered edge's term, source first (either way round if no term has
them so); its last two receive the path's number at
the source and at the target, which differ by the edge's shift.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datarill.functions.domains import DomainTooLarge
from datarill.functions.spread import spread
from datarill.plans.ast import Atom, ProgramError, Rule, Var
from datarill.plans.strata import components

#: Edges that are numbered on the driver at most.
MAX_EDGES = 1_000_000
#: Path numbers of a relation at most. They are made by the tasks, so this guards against outputs that nobody could store.
MAX_PATHS = 1 << 34
#: Path numbers that a row is turned into at once.
CHUNK = 4096


def path_ranges(roots: list, edges: list[tuple]) -> tuple[dict, dict]:
    """Paths per node, and per edge (source, target, ...) its (start at the target, paths); roots and ends are hashable nodes."""
    after: dict = {}
    for e in edges:
        after.setdefault(e[0], []).append(e[1])
    nodes = sorted({*roots, *after, *(e[1] for e in edges)}, key=repr)
    reached, queue = set(roots), list(roots)
    while queue:
        for t in after.get(queue.pop(), ()):
            if t not in reached:
                reached.add(t)
                queue.append(t)
    number = {n: i for i, n in enumerate(nodes)}
    parts = components(list(range(len(nodes))), {number[n]: [number[t] for t in to] for n, to in after.items()})
    of = {nodes[x]: k for k, part in enumerate(parts) for x in part}
    count = [0] * len(parts)
    incoming: dict[int, list[tuple]] = {}
    for e in edges:
        if e[0] in reached and of[e[0]] != of[e[1]]:
            incoming.setdefault(of[e[1]], []).append(e)
    start: dict = {}
    rooted: dict[int, int] = {}
    for r in set(roots):
        rooted[of[r]] = rooted.get(of[r], 0) + 1
    for k in range(len(parts) - 1, -1, -1):  # components() lists what is pointed to first
        count[k] = rooted.get(k, 0)
        for e in sorted(incoming.get(k, ()), key=lambda e: (e[2], repr(e[0]), repr(e[1]))):
            start[e] = (count[k], count[of[e[0]]])
            count[k] += count[of[e[0]]]
    for e in edges:
        if e[0] in reached and of[e[0]] == of[e[1]]:
            start[e] = (0, count[of[e[0]]])
    return {n: count[of[n]] for n in nodes if n in reached}, start


def draw_ranges(paths: dict, start: dict) -> Iterator[str]:
    """Lines of the numbered graph as DOT text: path numbers at each node, and at the target of each edge."""
    quote = lambda node: '"' + f"{node[0]} {node[1]}".replace("\\", "\\\\").replace('"', '\\"') + '"'
    yield "digraph {\n"
    for n, k in sorted(paths.items(), key=lambda x: repr(x[0])):
        yield f'  {quote(n)} [label="{n[0]} {n[1]}: 0..{k - 1}"];\n'
    for e, (s, k) in sorted(start.items(), key=lambda x: repr(x[0])):
        yield f'  {quote(e[0])} -> {quote(e[1])} [label="{s}..{s + k - 1}"];\n'
    yield "}\n"


def number_edges(rule: Rule, table: Callable[[Atom, int], DataFrame], graph: str | None = None) -> tuple[list[tuple], bool]:
    """The numbered edges as the head's two elements, paths, and first number at the target; and whether they come from one term.

    graph names a folder for a drawing of the numbered graph, as <relation>.dot.
    """
    roots, *terms = rule.atoms()
    head = [a.name for a in rule.head.args if isinstance(a, Var)]
    if len(head) != 4 or len(rule.head.args) != 4:
        raise ProgramError(f"line {rule.line}: the head of a number rule has two variables of an edge and two numbers")
    bound = [a.name for a in roots.args if isinstance(a, Var)]
    elsewhere = {v.name for t in terms for v in t.args if isinstance(v, Var)}
    root_vars = [n for n in bound if n in elsewhere] or bound
    if len(root_vars) != 1:
        raise ProgramError(f"line {rule.line}: the roots need one variable")
    at = next(i for i, a in enumerate(roots.args) if isinstance(a, Var) and a.name == root_vars[0])
    root_rows = [(root_vars[0], r[0]) for r in table(roots, 0).select(f"_{at}").distinct().limit(MAX_EDGES + 1).collect()]
    edges = []
    for k, t in enumerate(terms, 1):
        names = [a.name for a in t.args if isinstance(a, Var)]
        if len(names) != 2 or len(t.args) != 2:
            raise ProgramError(f"line {rule.line}: {t.relation} must be a binary edge")
        rows = table(t, k).select("_0", "_1").limit(MAX_EDGES + 1).collect()
        if len(rows) > MAX_EDGES or len(root_rows) > MAX_EDGES:
            raise ProgramError(f"line {rule.line}: more than {MAX_EDGES} edges can't be numbered")
        edges += [((names[0], r[0]), (names[1], r[1]), k) for r in rows]
    order = {k: [a.name for a in t.args if isinstance(a, Var)] for k, t in enumerate(terms, 1)}
    chosen = {k for k, names in order.items() if names == head[:2]} or {k for k, names in order.items() if names == [head[1], head[0]]}
    if not chosen:
        raise ProgramError(f"line {rule.line}: no edge has both {head[0]} and {head[1]}")
    paths, start = path_ranges(root_rows, edges)
    if graph:
        with open(os.path.join(graph, f"{rule.head.relation}.dot"), "w", encoding="utf-8") as file:
            file.writelines(draw_ranges(paths, start))
    rows = []
    for e, (shift, n) in start.items():
        if e[2] in chosen:
            values = {e[0][0]: e[0][1], e[1][0]: e[1][1]}
            rows.append((int(values[head[0]]), int(values[head[1]]), n, shift))
    return [r for r in rows if r[2] > 0], len(chosen) == 1


def number_ranges(spark: SparkSession, rule: Rule, table: Callable[[Atom, int], DataFrame], graph: str | None = None) -> DataFrame:
    """A row (_0, _1, n, shift) for each numbered edge: its path numbers are 0 to n - 1 at its source, and shift more at its target."""
    return spark.createDataFrame(number_edges(rule, table, graph)[0], "_0 long, _1 long, n long, shift long")


def number_paths(spark: SparkSession, rule: Rule, table: Callable[[Atom, int], DataFrame], graph: str | None = None) -> DataFrame:
    """Rows of the head: the numbered edge's variables, path number at its source, path number at its target."""
    rows, one = number_edges(rule, table, graph)
    total = sum(r[2] for r in rows)
    if total > MAX_PATHS:
        raise DomainTooLarge(f"line {rule.line}: {total} path numbers are more than {MAX_PATHS}")
    frame = spark.createDataFrame(rows, "_0 long, _1 long, n long, shift long")
    frame = frame.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("at"))
    numbers = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.col("n")) - 1)).alias("x")
    frame = spread(frame, "_0", "_1", "at").select("_0", "_1", "shift", numbers)
    out = frame.select("_0", "_1", F.col("x").alias("_2"), (F.col("x") + F.col("shift")).alias("_3"))
    # Numbers of one term's edges are distinct as they are.
    return out if one else out.distinct()
