"""Rules with the split option, cut into rules of two terms over relations in between."""

from __future__ import annotations

from .ast import Atom, Compare, MapInto, Program, RelationDecl, Rule, Var
from .validate import domains_of


def _names(terms) -> list[str]:
    out: list[str] = []
    for t in terms:
        args = t.args if isinstance(t, Atom) else (t.left, t.right) if isinstance(t, (Compare, MapInto)) else ()
        out += [a.name for a in args if isinstance(a, Var) and a.name not in out]
    return out


def split_rule(program: Program, rule: Rule) -> list[Rule]:
    """The rules that stand for one; each relation in between keeps the variables that later terms or the head need."""
    known, out, body, k = domains_of(program, rule), [], list(rule.body), 0
    while len(positive := [t for t in body if isinstance(t, Atom) and not t.negated]) > 2:
        pair = positive[:2]
        rest = [t for t in body if not any(t is p for p in pair)]
        needed = set(_names([rule.head, *rest]))
        kept = [n for n in _names(pair) if n in needed]
        if not kept:
            break
        name, k = f"{rule.head.relation}_split{rule.line}_{k}", k + 1
        program.relations[name] = RelationDecl(name, [(n, known.get(n)) for n in kept], inferred=True)
        between = Atom(name, tuple(Var(n) for n in kept))
        out.append(Rule(between, pair, rule.line, priority=rule.priority))
        body = [between, *rest]
    return [*out, Rule(rule.head, body, rule.line, rule.options, rule.priority, rule.modifies, rule.pre, rule.post)] if out else [rule]


def split_rules(program: Program, rules: list[Rule]) -> list[Rule]:
    return [part for r in rules for part in (split_rule(program, r) if "split" in r.options and "number" not in r.options else [r])]
