"""Importer and exporter of relations stored as binary decision diagrams.

A file has an optional header (``# D:bits ...`` and one line of variables per
attribute), then the number of nodes and of variables, the level of each
variable, and the nodes ``id var low high`` with the root last. Without a header
the attributes' variables follow from the order in which the domains are
allocated (bddinfo). The first variable of an attribute is its lowest bit.

Decoding walks the diagram once on the driver and yields cubes; the tuples of a
cube's free bits are expanded on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datarill.functions.domains import ENUMERATION_LIMIT, DomainTooLarge
from datarill.operators.compile import columns
from datarill.sources.tuples import bits


def layout(info: list[str], sizes: dict[str, int]) -> dict[str, list[int]]:
    """Variables of each allocated domain copy, in order: D0, D1, ..."""
    out, at, seen = {}, 0, {}
    for name in info:
        k = seen[name] = seen.get(name, -1) + 1
        n = bits(sizes[name])
        out[f"{name}{k}"] = list(range(at, at + n))
        at += n
    return out


def parse(text: str, attributes: list[list[int]] | None) -> tuple[list[list[int]], int | bool, dict[int, tuple[int, int, int]], dict[int, int]]:
    """Variables per attribute, root, nodes, and the level of each variable."""
    lines = text.replace("\r", "").split("\n")
    marked = [x[1:].split() for x in lines if x.startswith("#")]
    if marked and any(":" in x for x in marked[0]):
        attributes = [[int(v) for v in x] for x in marked[1 : 1 + len(marked[0])]]
    if attributes is None:
        raise ValueError("a file without a header needs the layout of its domains")
    numbers = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    count, total = int(numbers[0][0]), int(numbers[0][1])
    if count == 0 and total == 0:
        return attributes, bool(int(numbers[0][2])) if len(numbers[0]) > 2 else False, {}, {}
    flat = [int(x) for row in numbers[1:] for x in row]
    levels = {v: flat[v] for v in range(total)}
    nodes, root = {}, None
    for i in range(total, total + 4 * count, 4):
        root, var, low, high = flat[i : i + 4]
        nodes[root] = (var, low, high)
    return attributes, root, nodes, levels


def cubes(root, nodes: dict, attributes: list[list[int]]):
    """Per path to true: for each attribute the fixed value and the list of free bits."""
    if root is True or root is False or not nodes:
        if root is True:
            yield [(0, list(range(len(v)))) for v in attributes]
        return
    place = {v: (i, b) for i, vs in enumerate(attributes) for b, v in enumerate(vs)}
    stack = [(root, {})]
    while stack:
        node, fixed = stack.pop()
        if node == 0:
            continue
        if node == 1:
            out = []
            for i, vs in enumerate(attributes):
                value = sum(1 << b for b in range(len(vs)) if fixed.get((i, b)))
                out.append((value, [b for b in range(len(vs)) if (i, b) not in fixed]))
            yield out
            continue
        var, low, high = nodes[node]
        at = place.get(var)
        if at is None:
            raise ValueError(f"variable {var} belongs to no attribute")
        stack.append((low, {**fixed, at: False}))
        stack.append((high, {**fixed, at: True}))


def read_bdd(spark: SparkSession, path: str, kinds: list[str], sizes: dict[str, int], info: str | None = None, copies: list[str] | None = None, limit: int = ENUMERATION_LIMIT) -> DataFrame:
    """The tuples of a file. kinds are the attributes' domains; copies their allocated copies (``V1``), where known."""
    with open(path, encoding="ascii", errors="replace") as file:
        text = file.read()
    attributes = None
    if not text.startswith("#"):
        if info is None:
            raise ValueError(f"{path} has no header")
        with open(info, encoding="ascii") as file:
            places = layout(file.read().split(), sizes)
        used: dict[str, int] = {}
        names = []
        for d in kinds:
            names.append(f"{d}{used.get(d, 0)}")
            used[d] = used.get(d, 0) + 1
        attributes = [places[c] for c in (copies or names)]
    attributes, root, nodes, _ = parse(text, attributes)
    rows, total = [], 0
    for cube in cubes(root, nodes, attributes):
        n = 1
        for _, free in cube:
            n <<= len(free)
        total += n
        if total > limit:
            raise DomainTooLarge(f"{path} has more than {limit} tuples")
        rows.append(tuple(x for value, free in cube for x in (value, [1 << b for b in free])))
    schema = ", ".join(f"v{i} long, f{i} array<long>" for i in range(len(attributes)))
    df = spark.createDataFrame(rows, schema)
    for i in range(len(attributes)):
        # All sums of subsets of the free bits.
        sums = F.aggregate(f"f{i}", F.array(F.lit(0).cast("long")), lambda acc, bit: F.concat(acc, F.transform(acc, lambda x: x + bit)))
        df = df.withColumn(f"s{i}", F.explode(sums)).withColumn(f"_{i}", F.col(f"v{i}") + F.col(f"s{i}"))
    return df.select(*columns(len(attributes))).distinct()


def write_bdd(rows: list[tuple], path: str, domains: list[tuple[str, int]]) -> None:
    """Writes distinct tuples as a reduced diagram with a header; for relations that fit on the driver."""
    widths = [bits(s) for _, s in domains]
    order = [(i, b) for i, w in enumerate(widths) for b in range(w - 1, -1, -1)]
    variables, at = [], 0
    for w in widths:
        variables.append(list(range(at, at + w)))
        at += w
    unique: dict[tuple, int] = {}
    nodes: list[tuple] = []

    def build(part: list[tuple], depth: int) -> int:
        if not part:
            return 0
        if depth == len(order):
            return 1
        i, b = order[depth]
        low = build([r for r in part if not r[i] >> b & 1], depth + 1)
        high = build([r for r in part if r[i] >> b & 1], depth + 1)
        if low == high:
            return low
        key = (variables[i][b], low, high)
        if key not in unique:
            unique[key] = len(unique) + 2
            nodes.append((unique[key], *key))
        return unique[key]

    root = build(sorted(set(rows)), 0)
    head = "# " + " ".join(f"{d}{sum(1 for e, _ in domains[:k] if e == d)}:{w}" for k, ((d, _), w) in enumerate(zip(domains, widths))) + "\n"
    head += "".join("# " + " ".join(map(str, v)) + "\n" for v in variables)
    level = {variables[i][b]: k for k, (i, b) in enumerate(order)}
    with open(path, "w", encoding="ascii") as file:
        file.write(head)
        if root < 2:
            file.write(f"0 0 {root}\n")
            return
        file.write(f"{len(nodes)} {at}\n" + " ".join(str(level[v]) for v in range(at)) + "\n")
        file.writelines(" ".join(map(str, n)) + "\n" for n in nodes)
