"""Stratum by stratum evaluation; recursive strata by semi-naive rounds.

A stratum without recursion is one lazy plan per relation, so Catalyst sees
through it. In a recursive stratum every round joins the newest rows of one
body term with the full current values of the others, removes what is known by
an anti-join, and writes just the new rows to the shared folder. A relation's
value is the scan of its rounds' files, compacted now and then; lineage never
grows and lost executors cost one round at most.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datarill.functions.storage import read_shared, remove_shared, write_shared, write_sized
from datarill.operators.compile import RuleCompiler, Size, columns
from datarill.operators.numbering import number_paths
from datarill.plans.ast import Atom, Program, ProgramError, Rule
from datarill.plans.strata import Stratum
from datarill.streaming.hooks import Hooks

log = logging.getLogger(__name__)
#: Rounds of files after which a relation is written as one again.
COMPACT = 8


class NotConverged(RuntimeError):
    """A recursive stratum needed more rounds than allowed."""


@dataclass
class Options:
    max_iterations: int = 100_000
    incremental: bool = True
    trace: bool = False
    #: Stops loops silently after 128 rounds, as a compatibility switch.
    compat_128: bool = False
    #: Folder for drawings of the graphs that number rules number.
    number_graph: str | None = None


class Growing:
    """A relation while it grows: paths of its rounds, the newest one, and those before it."""

    def __init__(self, spark: SparkSession, name: str, df: DataFrame):
        self.spark, self.name, self.schema = spark, name, df.schema
        path, n, distinct = write_sized(df, name)
        self.paths = [path]
        #: Of all rows (the most values that a column had in one round), and of the newest.
        self.size: Size = (n, distinct)
        self.fresh: Size = self.size
        self.delta: str | None = self.paths[0]
        self.before: list[str] = []
        self.gone: list[str] = []

    def read(self, paths: list[str]) -> DataFrame:
        return read_shared(self.spark, paths, self.schema) if paths else empty_frame(self.spark, len(self.schema))

    def full(self) -> DataFrame:
        return self.read(self.paths)

    def newest(self) -> DataFrame:
        return self.read([self.delta])

    def older(self) -> DataFrame:
        """What was known before the newest rows."""
        return self.read(self.before)

    def unseen(self, df: DataFrame) -> tuple[str, int, list[int]]:
        """Writes the rows of df that aren't known; their place and size."""
        fresh = df.join(self.full(), columns(len(self.schema)), "left_anti") if len(self.schema) else df
        return write_sized(fresh, self.name)

    def grow(self, n: int, distinct: list[int]) -> None:
        self.fresh = (n, distinct)
        self.size = (self.size[0] + n, [max(a, b) for a, b in zip(self.size[1], distinct)])

    def take(self, path: str, n: int, distinct: list[int]) -> int:
        """Makes what unseen() wrote the newest rows; without any there are none."""
        # What was rewritten a round ago isn't read by any plan now.
        remove_shared(self.spark, self.gone)
        self.gone = []
        if not n:
            remove_shared(self.spark, [path])
            self.delta = None
            return 0
        self.grow(n, distinct)
        self.before = list(self.paths)
        self.paths.append(path)
        self.delta = path
        if len(self.paths) > COMPACT:
            whole = write_shared(self.full(), self.name)
            self.gone = [p for p in self.paths if p != path]
            self.paths = [whole]
        return n

    def add(self, df: DataFrame) -> int:
        """Appends the rows of df that aren't known beside the newest ones; returns their number."""
        path, n, distinct = self.unseen(df)
        if not n:
            remove_shared(self.spark, [path])
            return 0
        earlier = self.fresh if self.delta else (0, distinct)
        self.grow(n, distinct)
        self.fresh = (n + earlier[0], [max(a, b) for a, b in zip(distinct, earlier[1])])
        self.paths.append(path)
        self.delta = write_shared(self.read([self.delta, path]), self.name) if self.delta else path
        return n


class Evaluator:
    def __init__(self, spark: SparkSession, program: Program, compiler: RuleCompiler, values: dict[str, DataFrame], empty: Callable[[str], DataFrame], hooks: Hooks, options: Options):
        self.spark, self.program, self.compiler = spark, program, compiler
        self.values, self.empty, self.hooks, self.options = values, empty, hooks, options
        self.rounds: dict[str, int] = {}

    def value(self, name: str) -> DataFrame:
        return self.values[name] if name in self.values else self.empty(name)

    def apply(self, rule: Rule, table: Callable[[Atom, int], DataFrame], first: int | None = None, sizes: Callable[[Atom, int], Size] | None = None) -> DataFrame:
        """The rule's rows over the given tables."""
        if rule.options & {"trace", "tracefull"} or self.options.trace:
            log.info("rule of line %s for %s", rule.line, rule.head.relation)
        if "tracefull" in rule.options:
            for i, t in enumerate(rule.body):
                if isinstance(t, Atom):
                    log.info("line %s, term %s: %s has %s rows", rule.line, i, t.relation, table(t, i).count())
        if "number" in rule.options:
            return number_paths(self.spark, rule, table, self.options.number_graph)
        found = self.compiler.compile(rule, table, first, sizes)
        if "single" in rule.options:
            found = found.orderBy(*found.columns).limit(1)
        return found

    def run(self, strata: list[Stratum]) -> None:
        for s in strata:
            if s.recursive or any(self.hooks.wanted(self.program, r) for r in s.rules) or any(self.program.relations[n].hook for n in s.relations):
                self._loop(s)
            else:
                self._once(s)

    def _once(self, s: Stratum) -> None:
        for name in s.relations:
            parts = [self.apply(r, lambda a, i: self.value(a.relation)) for r in s.rules if r.head.relation == name]
            if not parts:
                continue
            if name in self.values:
                parts.insert(0, self.values[name])
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.union(p)
            self.values[name] = whole.distinct() if len(parts) > 1 else whole

    def _loop(self, s: Stratum) -> None:
        inside = set(s.relations)
        below: dict[str, Size] = {}
        # What the loop reads from below is computed once.
        for name in sorted({a.relation for r in s.rules for a in r.atoms()} - inside):
            df = self.value(name)
            path, n, distinct = write_sized(df, name)
            below[name] = (n, distinct)
            self.values[name] = read_shared(self.spark, [path], df.schema)
        growing: dict[str, Growing] = {}

        def current(atom: Atom, i: int) -> DataFrame:
            return growing[atom.relation].full() if atom.relation in growing else self.value(atom.relation)

        def size(atom: Atom, i: int) -> Size:
            return growing[atom.relation].size if atom.relation in growing else below[atom.relation]

        for name in s.relations:
            growing[name] = Growing(self.spark, name, self.value(name))
        done = 0
        once: set[int] = set()  # number and single-pass rules whose sources don't change here
        while True:
            done += 1
            limit = 128 if self.options.compat_128 else self.options.max_iterations
            if done > limit:
                if self.options.compat_128:
                    break
                raise NotConverged(f"{', '.join(s.relations)}: no fixpoint after {limit} rounds")
            made: dict[str, list[DataFrame]] = {}
            asked: list[tuple[str, DataFrame]] = []
            for rule in s.rules:
                if rule.head.relation not in inside:
                    continue
                here = [i for i, t in enumerate(rule.body) if isinstance(t, Atom) and not t.negated and t.relation in inside]
                if "number" in rule.options:
                    if here:
                        raise ProgramError(f"line {rule.line}: a number rule can't be part of a recursion")
                if not here and id(rule) in once:
                    continue
                asked += self.hooks.before(rule, self._reader(growing), growing)
                if done == 1 or not self.options.incremental or not here:
                    made.setdefault(rule.head.relation, []).append(self.apply(rule, current, None, size))
                    once.add(id(rule))
                else:
                    for at in here:
                        if growing[rule.body[at].relation].delta is None:
                            continue
                        pick = lambda a, i, at=at: growing[a.relation].newest() if i == at else current(a, i)
                        picked = lambda a, i, at=at: growing[a.relation].fresh if i == at else size(a, i)
                        made.setdefault(rule.head.relation, []).append(self.apply(rule, pick, at, picked))
            # All plans of a round read the state before it, so they are written before any is added.
            written: dict[str, tuple[str, int]] = {}
            for name, parts in made.items():
                whole = parts[0]
                for p in parts[1:]:
                    whole = whole.union(p)
                written[name] = growing[name].unseen(whole.distinct() if len(parts) > 1 else whole)
            changed = 0
            for name in s.relations:
                g = growing[name]
                if name in written:
                    changed += g.take(*written[name])
                else:
                    g.delta = None
            for target, df in [*asked, *self.hooks.after(s, growing, self._reader(growing))]:
                if target in growing:
                    changed += growing[target].add(df)
            if not changed:
                break
        for name, g in growing.items():
            remove_shared(self.spark, g.gone)
            self.values[name] = g.full()
            self.rounds[name] = done

    def _reader(self, growing: dict[str, Growing]) -> Callable[[str], DataFrame]:
        return lambda name: growing[name].full() if name in growing else self.value(name)


def empty_frame(spark: SparkSession, arity: int) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in columns(arity)]))


__all__ = ["Evaluator", "F", "NotConverged", "Options", "empty_frame"]
