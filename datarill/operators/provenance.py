"""Come-from queries: rules that collect every tuple that takes part in deriving the asked ones."""

from __future__ import annotations

from datarill.plans.ast import Atom, Blank, Compare, Const, Every, MapInto, Program, RelationDecl, Rule, Var
from datarill.plans.parser import variables


def _fresh(program: Program, name: str, attributes: list[tuple[str, str | None]]) -> str:
    program.relations[name] = RelationDecl(name, attributes, {"printtuples"}, inferred=True)
    return name


def _named(atom: Atom, prefix: str) -> tuple[Atom, list[Compare]]:
    """The atom with a variable in each place, and what its constants asked for."""
    args, extra = [], []
    for i, a in enumerate(atom.args):
        if isinstance(a, Var):
            args.append(a)
            continue
        v = Var(f"{prefix}{i}")
        args.append(v)
        if isinstance(a, Const):
            extra.append(Compare(v, "=", a))
    return Atom(atom.relation, tuple(args)), extra


def come_from(program: Program, start: Atom, single: bool = False) -> tuple[list[Rule], list[str]]:
    """The rules to add and the relations they define.

    ``q_R`` holds the tuples of R that matter; ``q<k>_R`` the bindings of rule k
    that derive some of them; ``q<k>_noC_R`` the same without variables whose
    names begin with c, which by convention are contexts. The asked relation's
    own seed keeps constants; ``_`` asks for any value.
    """
    rules: list[Rule] = []
    names: list[str] = []
    known: set[str] = set()

    def relation(name: str) -> str:
        target = f"q_{name}"
        if target not in known:
            known.add(target)
            names.append(_fresh(program, target, list(program.relations[name].attributes)))
        return target

    seed, asked = _named(start, "s$")
    rules.append(Rule(Atom(relation(start.relation), seed.args), [seed, *asked], options=set()))
    queue, done = [start.relation], set()
    while queue:
        name = queue.pop(0)
        if name in done:
            continue
        done.add(name)
        for k, rule in enumerate(program.rules):
            if rule.head.relation != name or "number" in rule.options:
                continue
            head, fixed = _named(rule.head, "h$")
            body = list(rule.body)
            shown = list(dict.fromkeys(v.name for t in [head, *body] for v in variables(t) if not v.name.startswith("h$")))
            kinds = _kinds(program, rule, shown)
            bindings = Atom(_fresh(program, f"q{k}_{name}", [(n, kinds.get(n)) for n in shown]), tuple(Var(n) for n in shown))
            names.append(bindings.relation)
            sought = Atom(relation(name), head.args)
            rules.append(Rule(bindings, [sought, *fixed, *body], rule.line, {"single"} if single else set()))
            plain = [n for n in shown if not n.startswith("c")]
            if len(plain) < len(shown) and plain:
                bare = Atom(_fresh(program, f"q{k}_noC_{name}", [(n, kinds.get(n)) for n in plain]), tuple(Var(n) for n in plain))
                names.append(bare.relation)
                rules.append(Rule(bare, [bindings], rule.line))
            for t in body:
                if isinstance(t, Atom) and not t.negated:
                    places, given = _named(t, "p$")
                    free = [a for a in places.args if isinstance(a, Var) and a.name.startswith("p$")]
                    # Places without a variable of the rule are filled from the relation itself.
                    more = [Atom(t.relation, places.args)] if free else []
                    rules.append(Rule(Atom(relation(t.relation), places.args), [bindings, *more, *given], rule.line))
                    queue.append(t.relation)
    for r in rules:
        r.body = [_single_to_blank(t, r) if isinstance(t, Atom) else t for t in r.body]
    return rules, names


def _kinds(program: Program, rule: Rule, shown: list[str]) -> dict[str, str | None]:
    from datarill.plans.validate import domains_of

    return domains_of(program, rule)


def _single_to_blank(atom: Atom, rule: Rule) -> Atom:
    """Variables that stand in one place of the rule only become ``_``."""
    uses: dict[str, int] = {}
    for t in [rule.head, *rule.body]:
        for v in variables(t):
            uses[v.name] = uses.get(v.name, 0) + 1
    return Atom(atom.relation, tuple(Blank() if isinstance(a, Var) and uses[a.name] == 1 else a for a in atom.args), atom.negated)


__all__ = ["Every", "MapInto", "come_from"]
