"""Which rules are needed, in which order, and which of them are recursive together."""

from __future__ import annotations

from dataclasses import dataclass

from .ast import Program, ProgramError, Rule


@dataclass
class Stratum:
    relations: list[str]
    rules: list[Rule]
    recursive: bool


def _sources(rule: Rule) -> list[str]:
    return [a.relation for a in rule.atoms()]


def _heads(rule: Rule) -> list[str]:
    return [rule.head.relation, *rule.modifies]


def components(nodes: list[str], edges: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, each after those it points to (Tarjan, without recursion)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for start in nodes:
        if start in index:
            continue
        work = [(start, iter(edges.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(edges.get(to, ()))))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    out.append(sorted(part))
    return out


def needed(rules: list[Rule], outputs: list[str]) -> tuple[list[Rule], set[str]]:
    """The rules and relations that the outputs depend on."""
    by_head: dict[str, list[Rule]] = {}
    for r in rules:
        for h in _heads(r):
            by_head.setdefault(h, []).append(r)
    relations, queue, kept = set(outputs), list(outputs), []
    seen: set[int] = set()
    while queue:
        for r in by_head.get(queue.pop(), ()):
            if id(r) not in seen:
                seen.add(id(r))
                kept.append(r)
                for s in [*_sources(r), *_heads(r)]:
                    if s not in relations:
                        relations.add(s)
                        queue.append(s)
    order = {id(r): i for i, r in enumerate(rules)}
    return sorted(kept, key=lambda r: order[id(r)]), relations


def stratify(program: Program, rules: list[Rule], outputs: list[str], given: set[str]) -> list[Stratum]:
    """Strata in the order of evaluation; ``given`` are relations that have rows from elsewhere."""
    rules, relations = needed(rules, outputs)
    # What can have rows at all: inputs, and heads of rules whose positive sources can.
    possible = set(given)
    changed = True
    while changed:
        changed = False
        for r in rules:
            for h in _heads(r):
                if h not in possible and all(a.negated or a.relation in possible for a in r.atoms()):
                    possible.add(h)
                    changed = True
    lost = sorted(r for r in relations if r not in possible)
    if lost:
        raise ProgramError(f"relation {lost[0]} is needed, but no input or fact leads to it")
    edges: dict[str, list[str]] = {r: [] for r in sorted(relations)}
    for r in rules:
        for h in _heads(r):
            edges[h] += [s for s in _sources(r) if s not in edges[h]]
        for h in r.modifies:
            edges[r.head.relation].append(h) if h not in edges[r.head.relation] else None
            edges[h].append(r.head.relation) if r.head.relation not in edges[h] else None
    out = []
    for part in components(sorted(relations), edges):
        inside = set(part)
        mine = sorted((r for r in rules if inside & set(_heads(r))), key=lambda r: r.priority)
        for r in mine:
            for a in r.atoms():
                if a.negated and a.relation in inside:
                    raise ProgramError(f"line {r.line}: not stratifiable: {r.head.relation} and the negation of {a.relation} depend on each other")
        recursive = any(a.relation in inside for r in mine for a in r.atoms()) or any(r.modifies for r in mine)
        out.append(Stratum(part, mine, recursive))
    return out
