"""A plain set-based evaluator for small programs: naive rounds over all assignments, no Spark."""

from itertools import product

from datarill.plans.ast import Atom, Blank, Compare, Const, Every, Var
from datarill.plans.parser import variables

OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def holds(term, env, values, sizes, alone):
    if isinstance(term, Compare):
        get = lambda x: env[x.name] if isinstance(x, Var) else x.value
        return OPS[term.op](get(term.left), get(term.right))
    rows = values.get(term.relation, set())
    size = sizes[term.relation]
    some = [i for i, a in enumerate(term.args) if isinstance(a, Blank) or isinstance(a, Var) and a.name in alone]
    every = [i for i, a in enumerate(term.args) if isinstance(a, Every)]

    def member(choice):
        row = tuple(choice[i] if i in choice else (a.value if isinstance(a, Const) else env[a.name]) for i, a in enumerate(term.args))
        return (row in rows) != term.negated

    options = [range(size[i]) for i in some]
    for pick in product(*options):
        if all(member({**dict(zip(some, pick)), **dict(zip(every, rest))}) for rest in product(*[range(size[i]) for i in every])):
            return True
    return False


def evaluate(program, facts, strata):
    """Values of all relations after the strata, each run to its fixpoint by naive rounds."""
    values = {k: set(v) for k, v in facts.items()}
    sizes = {n: [program.domains[d].size for _, d in r.attributes] for n, r in program.relations.items()}
    for s in strata:
        while True:
            before = {n: set(values.get(n, ())) for n in s.relations}
            for rule in s.rules:
                uses = {}
                for t in [rule.head, *rule.body]:
                    for n in {v.name for v in variables(t)}:
                        uses[n] = uses.get(n, 0) + 1
                domain = {}
                for a in [rule.head, *rule.atoms()]:
                    for x, n in zip(a.args, sizes[a.relation]):
                        if isinstance(x, Var):
                            domain[x.name] = n
                alone = {n for n, k in uses.items() if k == 1 and n not in {v.name for v in variables(rule.head)}}
                names = [n for n in domain if n not in alone]
                for pick in product(*[range(domain[n]) for n in names]):
                    env = dict(zip(names, pick))
                    if all(holds(t, env, values, sizes, alone) for t in rule.body):
                        spots = [[a.value] if isinstance(a, Const) else [env[a.name]] if isinstance(a, Var) else range(n) for a, n in zip(rule.head.args, sizes[rule.head.relation])]
                        values.setdefault(rule.head.relation, set()).update(product(*spots))
            if all(values.get(n, set()) == before[n] for n in s.relations):
                break
    return values


__all__ = ["Atom", "evaluate"]
