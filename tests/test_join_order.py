"""Orders of a rule's joins by the sizes of its terms."""

from datarill.operators.compile import RuleCompiler
from datarill.plans.parser import parse
from datarill.plans.validate import validate
from datarill.queries import POINTS_TO


def test_a_small_newest_term_does_not_lead_into_a_product(spark):
    program = parse("K 1048576\n" + POINTS_TO)
    validate(program)
    rule = next(r for r in program.rules if {a.relation for a in r.atoms()} == {"L", "vP", "hP"})
    sizes = {"L": (1_000_000, [1_000_000, 3, 200_000]), "vP": (25_000_000, [1_000_000, 25]), "hP": (600, [25, 3, 25])}
    positive = sorted(enumerate(rule.body), key=lambda x: x[1].relation != "hP")
    order = RuleCompiler(spark, program, {}).order(rule, positive, lambda a, i: sizes[a.relation])
    # hP shares only a field with L, or an object with vP: joined to either first it makes hundreds of rows of each.
    assert order[-1][1].relation == "hP" and {t.relation for _, t in order} == set(sizes)
    few = {**sizes, "vP": (10, [10, 5])}
    assert RuleCompiler(spark, program, {}).order(rule, positive, lambda a, i: few[a.relation])[0][1].relation != "hP"
