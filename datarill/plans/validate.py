"""Checks of rules against declarations, and declarations that rules imply."""

from __future__ import annotations

from collections import Counter

from .ast import Atom, Blank, Compare, Const, Every, MapInto, Program, ProgramError, RelationDecl, Rule, Var
from .parser import variables


def _declare(program: Program, rule: Rule, strict: bool) -> None:
    """Declares relations that the rule uses first, named after its variables."""
    for atom in [rule.head, *rule.atoms()]:
        if atom.relation in program.relations:
            continue
        if strict:
            raise ProgramError(f"line {rule.line}: relation {atom.relation} isn't declared")
        if not all(isinstance(a, Var) for a in atom.args):
            raise ProgramError(f"line {rule.line}: relation {atom.relation} isn't declared, and can't be inferred from constants, _ or *")
        program.relations[atom.relation] = RelationDecl(atom.relation, [(a.name, None) for a in atom.args], inferred=True)


def domains_of(program: Program, rule: Rule) -> dict[str, str]:
    """The domain of each variable of a rule, as far as known; a variable in two domains is an error."""
    found: dict[str, str] = {}
    for atom in [rule.head, *rule.atoms()]:
        decl = program.relations[atom.relation]
        if len(atom.args) != decl.arity:
            raise ProgramError(f"line {rule.line}: {atom.relation} has {decl.arity} attributes, not {len(atom.args)}")
        for arg, (_, domain) in zip(atom.args, decl.attributes):
            if isinstance(arg, Var) and domain and found.setdefault(arg.name, domain) != domain:
                raise ProgramError(f"line {rule.line}: {arg.name} is used in domains {found[arg.name]} and {domain}")
    return found


def infer_domains(program: Program, rules: list[Rule]) -> None:
    """Gives inferred relations the domains of the variables in their places, until nothing changes."""
    changed = True
    while changed:
        changed = False
        for rule in rules:
            known = domains_of(program, rule)
            for t in rule.body:
                if isinstance(t, Compare) and isinstance(t.left, Var) and isinstance(t.right, Var):
                    for a, b in ((t.left.name, t.right.name), (t.right.name, t.left.name)):
                        if a in known:
                            known.setdefault(b, known[a])
            for atom in [rule.head, *rule.atoms()]:
                decl = program.relations[atom.relation]
                for i, arg in enumerate(atom.args):
                    name, domain = decl.attributes[i]
                    if domain is None and isinstance(arg, Var) and arg.name in known:
                        decl.attributes[i] = (name, known[arg.name])
                        changed = True


def check_rule(program: Program, rule: Rule, single_use: bool) -> None:
    known = domains_of(program, rule)
    for atom in rule.atoms():
        names = [a.name for a in atom.args if isinstance(a, Var)]
        if len(names) != len(set(names)) and "number" not in rule.options:
            raise ProgramError(f"line {rule.line}: a variable stands twice in {atom.relation}; write another and compare them")
    names = [a.name for a in rule.head.args if isinstance(a, Var)]
    if len(names) != len(set(names)) and "number" not in rule.options:
        raise ProgramError(f"line {rule.line}: a variable stands twice in {rule.head.relation}; write another and compare them")
    seen = set(names)
    for term in rule.body:
        mine = {v.name for v in variables(term)}
        if isinstance(term, (Compare, MapInto)):
            later = {v.name for t in rule.body if isinstance(t, Atom) for v in variables(t)}
            if not mine & seen or isinstance(term, MapInto) and not mine <= seen | later:
                raise ProgramError(f"line {rule.line}: a comparison needs a variable that stands before it")
            if isinstance(term, Compare) and term.op in ("<", "<=", ">", ">=") and isinstance(term.left, Var) and isinstance(term.right, Var):
                a, b = known.get(term.left.name), known.get(term.right.name)
                if a and b and a != b:
                    raise ProgramError(f"line {rule.line}: {term.left.name} and {term.right.name} are of different domains")
        seen |= mine
    uses = Counter(v.name for t in [rule.head, *rule.body] for v in variables(t))
    once = [n for n, k in uses.items() if k == 1]
    if once and not single_use and "number" not in rule.options:
        raise ProgramError(f"line {rule.line}: variable {once[0]} is used once only; write _ instead")
    if "number" in rule.options and len(rule.body) < 2:
        raise ProgramError(f"line {rule.line}: a number rule needs roots and edges")


def validate(program: Program, rules: list[Rule] | None = None) -> Program:
    """Checks the rules and completes the declarations; queries count as rules without the check for single uses."""
    on = lambda s: program.settings.get(s, "no") not in ("no", "false")
    rules = program.rules if rules is None else rules
    for rule in rules:
        _declare(program, rule, on("strict"))
    infer_domains(program, rules)
    for rule in rules:
        check_rule(program, rule, on("singleignore"))
    return program


__all__ = ["Blank", "Every", "Const", "check_rule", "domains_of", "infer_domains", "validate"]
