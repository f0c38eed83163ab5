"""One rule to one DataFrame plan: selections, projections, joins, comparisons, negation, quantifiers.

Relations are DataFrames with columns _0, _1, ... and distinct rows without
nulls. Inside a rule each variable is a column named v_<variable>. The plan is
declarative: constants become filters that reach the scans, unused columns are
never selected, and Catalyst picks the joins.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datarill.functions.domains import ENUMERATION_LIMIT, Domain, DomainTooLarge, enumerate_values
from datarill.functions.spread import spread
from datarill.plans.ast import Arg, Atom, Blank, Compare, Const, Every, MapInto, Program, ProgramError, Rule, Var
from datarill.plans.parser import variables
from datarill.plans.validate import domains_of

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}

#: Blocks of either side of a product from which a relation is taken away.
BLOCKS, SALTS = 64, 16
#: Rows of a key that stand in one block of a self join.
BLOCK_ROWS = 256
#: Terms of a rule whose orders are all compared.
MAX_ORDERED = 5
#: Rows of a table, and about how many values each column has.
Size = tuple[int, list[int]]


def columns(n: int) -> list[str]:
    return [f"_{i}" for i in range(n)]


class RuleCompiler:
    """Compiles the rules of a program against its domains."""

    def __init__(self, spark: SparkSession, program: Program, domains: dict[str, Domain], limit: int = ENUMERATION_LIMIT):
        self.spark, self.program, self.domains, self.limit = spark, program, domains, limit

    # ---- values and domains

    def _domain(self, name: str | None, what: str) -> Domain:
        if name is None or name not in self.domains:
            raise DomainTooLarge(f"{what} needs a declared domain")
        return self.domains[name]

    def value(self, const: Const, domain: str | None) -> Column:
        """The literal of a constant: a name of a domain with names is its element, else it stands for itself."""
        if isinstance(const.value, str):
            d = self.domains.get(domain or "")
            if d is not None and d.size is not None:
                return F.lit(d.index(const.value, self.program.warnings)).cast("long")
            return F.lit(const.value)
        return F.lit(const.value).cast("long")

    def _attribute_domain(self, atom: Atom, i: int) -> str | None:
        return self.program.relations[atom.relation].attributes[i][1]

    def _ranges(self, wanted: dict[str, str | None], what: str) -> DataFrame:
        """All combinations of values of some columns."""
        parts = enumerate_values(self.spark, [self._domain(d, what) for d in wanted.values()], what, self.limit)
        out = None
        for column, part in zip(wanted, parts):
            part = part.withColumnRenamed("_v", column)
            out = part if out is None else out.crossJoin(part)
        return out

    # ---- terms

    def scan(self, atom: Atom, df: DataFrame, keep: set[str] | None = None) -> DataFrame:
        """A positive term's bindings: constants filtered, ``_`` and columns nobody keeps dropped, ``*`` divided out."""
        every = [i for i, a in enumerate(atom.args) if isinstance(a, Every)]
        for i, a in enumerate(atom.args):
            if isinstance(a, Const):
                df = df.where(F.col(f"_{i}") == self.value(a, self._attribute_domain(atom, i)))
        first: dict[str, int] = {}
        for i, a in enumerate(atom.args):
            if isinstance(a, Var):
                if a.name in first:  # only number rules
                    df = df.where(F.col(f"_{i}") == F.col(f"_{first[a.name]}"))
                else:
                    first[a.name] = i
        named = {n: i for n, i in first.items() if keep is None or n in keep or every}
        shown = [F.col(f"_{i}").alias(f"v_{n}") for n, i in named.items()]
        if every:
            # For all values: each group must have as many distinct ones as the domains have elements.
            size = 1
            for i in every:
                d = self._domain(self._attribute_domain(atom, i), f"* in {atom.relation}")
                if d.size is None:
                    raise DomainTooLarge(f"* in {atom.relation} needs a size for domain {d.name}")
                size *= d.size
            inside = [F.col(f"_{i}").between(0, self._domain(self._attribute_domain(atom, i), "*").size - 1) for i in every]
            for c in inside:
                df = df.where(c)
            df = df.select(*shown, *[F.col(f"_{i}").alias(f"q_{i}") for i in every]).distinct()
            out = df.groupBy(*[f"v_{n}" for n in named]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")
            return out if named else out.select(F.lit(True).alias("_true"))
        if not named:
            return df.select(F.lit(True).alias("_true")).limit(1)
        out = df.select(*shown)
        return out if len(named) == len(atom.args) else out.distinct()

    def negate(self, bound: DataFrame, atom: Atom, df: DataFrame, alone: set[str], known: dict[str, str]) -> DataFrame:
        """The rows of ``bound`` for which the negated term holds.

        ``_`` and variables of no other term are "for some value" after the
        complement: the row counts of the domain must not all be there. ``*`` is
        "for all values" after it: no row may be there.
        """
        some = [i for i, a in enumerate(atom.args) if isinstance(a, Blank) or isinstance(a, Var) and a.name in alone]
        for i, a in enumerate(atom.args):
            if isinstance(a, Const):
                df = df.where(F.col(f"_{i}") == self.value(a, self._attribute_domain(atom, i)))
        names = {a.name: i for i, a in enumerate(atom.args) if isinstance(a, Var) and a.name not in alone}
        if some:
            every = [i for i, a in enumerate(atom.args) if isinstance(a, Every)]
            size = 1
            for i in some:
                d = self._domain(self._attribute_domain(atom, i), f"_ in !{atom.relation}")
                if d.size is None:
                    raise DomainTooLarge(f"_ in !{atom.relation} needs a size for domain {d.name}")
                size *= d.size
                df = df.where(F.col(f"_{i}").between(0, d.size - 1))
            if every:
                raise ProgramError(f"!{atom.relation} mixes _ and *")
            df = df.select(*[F.col(f"_{i}").alias(f"n_{n}") for n, i in names.items()], *[F.col(f"_{i}").alias(f"q_{i}") for i in some]).distinct()
            df = df.groupBy(*[f"n_{n}" for n in names]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")
            if not names:
                df = df.select(F.lit(True).alias("_true"))
        else:
            df = df.select(*[F.col(f"_{i}").alias(f"n_{n}") for n, i in names.items()]) if names else df.select(F.lit(True).alias("_true"))
        missing = {f"v_{n}": known.get(n) for n in names if f"v_{n}" not in bound.columns}
        if missing:
            values = self._ranges(missing, f"!{atom.relation}")
            bound = bound.crossJoin(values)
        if not names:
            return bound.join(df.limit(1), F.lit(True), "left_anti")
        return bound.join(df, [F.col(f"v_{n}") == F.col(f"n_{n}") for n in names], "left_anti")

    def product_without(self, left: DataFrame, right: DataFrame, atom: Atom, df: DataFrame) -> DataFrame | None:
        """left x right without the rows of a negated term that names right's only column and some of left's, or None if it doesn't.

        The pairs are never shuffled: right moves as BLOCKS arrays, the negated
        rows as lists by left's key and block, and each left row takes its list
        out of every block.
        """
        names = {f"v_{a.name}": i for i, a in enumerate(atom.args) if isinstance(a, Var)}
        mine = [c for c in left.columns if c.startswith("v_")]
        keys = [c for c in mine if c in names]
        b = right.columns[0]
        if len(right.columns) != 1 or b not in names or not keys or len(names) != len(atom.args) or set(names) != {b, *keys}:
            return None
        kind = right.schema[b].dataType
        if not isinstance(kind, (T.LongType, T.StringType)) or df.schema[f"_{names[b]}"].dataType != kind:
            return None
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOCKS)).cast("int")
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        taken = df.select(*[F.col(f"_{names[k]}").alias(k) for k in keys], F.col(f"_{names[b]}").alias("_b"))
        taken = taken.groupBy(*keys, block("_b").alias("_block")).agg(F.collect_list("_b").alias("_taken"))
        blocks = right.groupBy(block(b).alias("_block")).agg(F.collect_list(b).alias("_all")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = left.select(*mine, salt.alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_block"))
        rows = rows.join(taken, [*keys, "_block"], "left")
        rows = spread(rows, "_block", "_salt").join(spread(blocks, "_block", "_salt"), ["_block", "_salt"])
        return rows.select(*mine, F.explode(F.when(F.col("_taken").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_taken"))).alias(b))

    @staticmethod
    def _same_term(a: Atom, b: Atom, shared: list[str]) -> bool:
        """Whether two terms are of one relation and share variables just where they stand in both."""
        places = lambda t: [(i, x.name) for i, x in enumerate(t.args) if isinstance(x, Var) and x.name in shared]
        return a.relation == b.relation and places(a) == places(b)

    def pairs(self, left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
        """left joined to right on shared columns, without these; distinct.

        A key with k rows has k * k pairs, so right moves in blocks that left's
        rows are dealt to, and pairs come up where they are used. A left side with
        one key has each pair once; only those with several need a distinct.
        """
        mine, theirs = ([c for c in df.columns if c not in shared] for df in (left, right))
        blocks = right.groupBy(*shared).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
        row = F.col(theirs[0]) if len(theirs) == 1 else F.struct(*theirs)
        block = F.pmod(F.xxhash64(*theirs), F.col("_blocks")).cast("int").alias("_block")
        right = spread(right.join(blocks, shared).groupBy(*shared, block).agg(F.collect_list(row).alias("_rows")), *shared, "_block")
        keys = left.groupBy(*mine).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in shared])

        def joined(rows: DataFrame) -> DataFrame:
            rows = rows.join(blocks, shared).select(*mine, *shared, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
            found = spread(rows, *shared, "_block").join(right, [*shared, "_block"]).select(*mine, F.explode("_rows").alias("_row"))
            return found.select(*mine, *([F.col("_row").alias(theirs[0])] if len(theirs) == 1 else [F.col(f"_row.{c}") for c in theirs]))

        several = left.join(keys.where("_n > 1").select(*mine), mine, "left_semi")
        return joined(keys.where("_n = 1").select(*mine, *shared)).union(joined(several).distinct())

    # ---- rules

    def order(self, rule: Rule, positive: list[tuple[int, Atom]], sizes: Callable[[Atom, int], Size]) -> list[tuple[int, Atom]]:
        """The positive terms in the order whose joins make the fewest rows, by sizes; the given order among equals."""
        if not 2 <= len(positive) <= MAX_ORDERED:
            return positive
        outside = {v.name for v in variables(rule.head)} | {v.name for t in rule.body if not isinstance(t, Atom) or t.negated for v in variables(t)}

        def cost(terms: tuple) -> float:
            rows, seen, total = 1.0, {}, 0.0
            for k, (i, t) in enumerate(terms):
                n, distinct = sizes(t, i)
                there = {a.name: max(1, d) for a, d in zip(t.args, distinct) if isinstance(a, Var)}
                rows *= n / prod(max(1, d) for a, d in zip(t.args, distinct) if isinstance(a, Const))
                rows /= prod(max(seen[v], d) for v, d in there.items() if v in seen)
                total += rows if k else 0
                seen |= {v: min(d, seen.get(v, d)) for v, d in there.items()}
                wanted = outside | {v.name for _, u in terms[k + 1 :] for v in variables(u)}
                seen = {v: d for v, d in seen.items() if v in wanted}
                rows = min(rows, float(prod(seen.values())))  # what is dropped is followed by a distinct
            return total

        return list(min(permutations(positive), key=cost))

    def compile(self, rule: Rule, table: Callable[[Atom, int], DataFrame], first: int | None = None, sizes: Callable[[Atom, int], Size] | None = None) -> DataFrame:
        """Head rows of a rule, distinct. table(atom, i) gives the rows of body term i; term ``first`` leads the joins unless sizes make another order better."""
        known = domains_of(self.program, rule)
        for t in rule.body:  # equal variables share a domain
            if isinstance(t, Compare) and t.op == "=" and isinstance(t.left, Var) and isinstance(t.right, Var):
                for a, b in ((t.left.name, t.right.name), (t.right.name, t.left.name)):
                    if a in known:
                        known.setdefault(b, known[a])
        uses: dict[str, int] = {}
        for t in [rule.head, *rule.body]:
            for n in {v.name for v in variables(t)}:
                uses[n] = uses.get(n, 0) + 1
        positive = [(i, t) for i, t in enumerate(rule.body) if isinstance(t, Atom) and not t.negated]
        if first is not None:
            positive.sort(key=lambda x: x[0] != first)
        if sizes is not None:
            positive = self.order(rule, positive, sizes)
        pending = [t for t in rule.body if isinstance(t, (Compare, MapInto))]
        negated = [(i, t) for i, t in enumerate(rule.body) if isinstance(t, Atom) and t.negated]
        bound: DataFrame | None = None
        lead: Atom | None = None
        product: tuple[DataFrame, DataFrame, list] | None = None  # sides of the last join if nothing links them, and what was pending

        def later(names: set[str], rest: list[Atom]) -> set[str]:
            wanted = {v.name for v in variables(rule.head)} | {v.name for t in pending for v in variables(t)} | {v.name for _, t in negated for v in variables(t)}
            return names & (wanted | {v.name for t in rest for v in variables(t)})

        while positive:
            # The next term shares a variable with what is bound, if one does.
            at = 0
            if bound is not None:
                have = set(bound.columns)
                at = next((k for k, (_, t) in enumerate(positive) if any(f"v_{v.name}" in have for v in variables(t))), 0)
            i, atom = positive.pop(at)
            have = set() if bound is None else {c[2:] for c in bound.columns if c.startswith("v_")}
            mine = {v.name for v in variables(atom)}
            needed = later(mine, [t for _, t in positive]) | mine & have
            part = self.scan(atom, table(atom, i), needed)
            product = None
            if bound is None:
                bound, lead = part, atom
            else:
                shared = sorted(mine & have)
                if shared and not positive and lead is not None and self._same_term(lead, atom, shared) and not later(set(shared), []) and have - mine and mine - have == later(mine - have, []):
                    bound = self.pairs(bound, part.select(*sorted(part.columns)), [f"v_{n}" for n in shared])
                elif shared:
                    extra = [c for c in part.columns if c.startswith("v_") and c[2:] not in have]
                    bound = bound.join(part, [f"v_{n}" for n in shared], "inner" if extra else "left_semi")
                else:
                    product = (bound, part, pending)
                    bound = bound.drop("_true").crossJoin(part.drop("_true")) if part.columns != ["_true"] else bound.join(part, F.lit(True), "left_semi")
                lead = None
            bound, pending = self._compare(bound, pending, known, force=False)
            keep = [c for c in bound.columns if c.startswith("v_") and later({c[2:]}, [t for _, t in positive])]
            if positive and 0 < len(keep) < len([c for c in bound.columns if c.startswith("v_")]):
                bound = bound.select(*keep).distinct()
        if bound is None:
            bound = self.spark.range(1).select(F.lit(True).alias("_true"))
        bound, pending = self._compare(bound, pending, known, force=False)
        for i, atom in negated:
            alone = {v.name for v in variables(atom) if uses[v.name] == 1}
            apart = self.product_without(*product[:2], atom, table(atom, i)) if product and not alone else None
            if apart is not None:
                bound, pending = apart, product[2]
            else:
                bound = self.negate(bound, atom, table(atom, i), alone, known)
            product = None
            bound, pending = self._compare(bound, pending, known, force=False)
        bound, pending = self._compare(bound, pending, known, force=True)
        return self._head(rule, bound, known)

    def _compare(self, bound: DataFrame, pending: list, known: dict[str, str], force: bool) -> tuple[DataFrame, list]:
        """Applies the comparisons whose variables are bound; ``=`` and ``=>`` bind one side; force ranges over domains."""
        again = True
        while again:
            again, rest = False, []
            for t in pending:
                have = set(bound.columns)
                missing = [v.name for v in variables(t) if f"v_{v.name}" not in have]
                if isinstance(t, MapInto):
                    if len(missing) == 2 and force:
                        a, b = self._domain(known.get(t.left.name), "=>"), self._domain(known.get(t.right.name), "=>")
                        b.embed(a)
                        bound, missing, again = bound.crossJoin(self._ranges({f"v_{t.left.name}": a.name}, "=>")), [t.right.name], True
                    if len(missing) < 2:
                        bound, again = self._embed(bound, t, missing, known), True
                        continue
                    rest.append(t)
                    continue
                side = lambda x: F.col(f"v_{x.name}") if isinstance(x, Var) else None
                if not missing:
                    dom = next((known.get(v.name) for v in variables(t)), None)
                    left = side(t.left) if isinstance(t.left, Var) else self.value(t.left, dom)
                    right = side(t.right) if isinstance(t.right, Var) else self.value(t.right, dom)
                    bound = bound.where(_OPS[t.op](left, right))
                    again = True
                elif t.op == "=" and len(missing) == 1:
                    other = t.right if isinstance(t.left, Var) and t.left.name == missing[0] else t.left
                    value = side(other) if isinstance(other, Var) else self.value(other, known.get(missing[0]))
                    bound = bound.withColumn(f"v_{missing[0]}", value)
                    again = True
                elif force:
                    bound = bound.crossJoin(self._ranges({f"v_{missing[0]}": known.get(missing[0])}, f"{missing[0]} in a comparison"))
                    rest.append(t)
                    again = True
                else:
                    rest.append(t)
            pending = rest
        return bound, pending

    def _embed(self, bound: DataFrame, t: MapInto, missing: list[str], known: dict[str, str]) -> DataFrame:
        a, b = self._domain(known.get(t.left.name), "=>"), self._domain(known.get(t.right.name), "=>")
        offset = b.embed(a)
        left, right = f"v_{t.left.name}", f"v_{t.right.name}"
        count = len(a.names) or a.size
        if missing == [t.left.name]:
            bound = bound.withColumn(left, F.col(right) - F.lit(offset))
        elif missing == [t.right.name]:
            bound = bound.withColumn(right, F.col(left) + F.lit(offset))
        else:
            bound = bound.where(F.col(right) == F.col(left) + F.lit(offset))
        return bound.where(F.col(left).between(0, count - 1))

    def _head(self, rule: Rule, bound: DataFrame, known: dict[str, str]) -> DataFrame:
        out, free = [], {}
        for i, a in enumerate(rule.head.args):
            if isinstance(a, Const):
                out.append(self.value(a, self._attribute_domain(rule.head, i)).alias(f"_{i}"))
                continue
            name = f"v_{a.name}" if isinstance(a, Var) else f"f_{i}"
            if name not in bound.columns and name not in free:
                free[name] = known.get(a.name) if isinstance(a, Var) else self._attribute_domain(rule.head, i)
            out.append(F.col(name).alias(f"_{i}"))
        if free:
            bound = bound.crossJoin(self._ranges(free, f"line {rule.line}: an unbound head variable"))
        # Bound rows are distinct, so head rows are too unless a variable is dropped.
        kept = {f"v_{a.name}" for a in rule.head.args if isinstance(a, Var)}
        found = bound.select(*out)
        return found if {c for c in bound.columns if c.startswith("v_")} <= kept else found.distinct()


__all__ = ["Arg", "RuleCompiler", "columns"]
