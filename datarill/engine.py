"""The engine: a program, its relations bound to DataFrames, and solved values."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datarill.functions.domains import ENUMERATION_LIMIT, Domain
from datarill.operators.compile import RuleCompiler, columns
from datarill.operators.fixpoint import Evaluator, Options, empty_frame
from datarill.operators.numbering import number_ranges
from datarill.operators.provenance import come_from
from datarill.plans.ast import Atom, Program, ProgramError, Query, Rule
from datarill.plans.parser import Parser
from datarill.plans.split import split_rules
from datarill.plans.strata import Stratum, stratify
from datarill.plans.validate import validate
from datarill.sources import dot, maps, printing, tuples
from datarill.sources.bdd import read_bdd
from datarill.streaming.hooks import Hook, Hooks

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


class Engine:
    """Solves a program over bound relations.

    Relations take DataFrames by position; integer columns become long, rows
    with nulls are left out and duplicates removed, as relations are sets.
    """

    def __init__(
        self,
        spark: SparkSession,
        text: str = "",
        include_dirs: list[str] | None = None,
        hooks: dict[str, Hook] | None = None,
        limit: int = ENUMERATION_LIMIT,
        options: Options | None = None,
        strict_inputs: bool = False,
    ):
        self.spark, self.limit, self.options, self.strict_inputs = spark, limit, options or Options(), strict_inputs
        self.parser = Parser(include_dirs=include_dirs)
        self.program: Program = self.parser.program
        self.domains: dict[str, Domain] = {}
        self.bound: dict[str, DataFrame] = {}
        self.solved: dict[str, DataFrame] = {}
        self.hooks = Hooks(hooks, self.program)
        self.save_hooks: list[Callable[[Engine], None]] = []
        self.rounds: dict[str, int] = {}
        if text:
            self.load(text)

    # ---- program

    def load(self, text: str) -> Engine:
        """Adds statements of a program."""
        self.parser.parse(text)
        validate(self.program)
        self._domains()
        return self

    def _domains(self) -> None:
        for name, d in self.program.domains.items():
            if name not in self.domains:
                names = []
                if d.map_file:
                    path = os.path.join(self.program.basedir, d.map_file)
                    try:
                        names = maps.read_map(self.spark, path)
                    except OSError:
                        self.program.warnings.append(f"map file {path} can't be read")
                self.domains[name] = Domain(name, d.size, names)

    def domain(self, name: str, size: int | None = None, names: Iterable[str] = ()) -> Domain:
        """Declares or replaces a domain from here; without a size it is open."""
        from datarill.plans.ast import DomainDecl

        self.program.domains[name] = DomainDecl(name, size)
        self.domains[name] = Domain(name, size, list(names))
        return self.domains[name]

    def relation_schema(self, name: str) -> list[tuple[str, str | None]]:
        if name not in self.program.relations:
            raise ProgramError(f"relation {name} isn't declared")
        return self.program.relations[name].attributes

    # ---- inputs

    def bind(self, name: str, df: DataFrame, *cols: str) -> Engine:
        """Gives a relation its rows: the named columns of df, or all of them."""
        arity = len(self.relation_schema(name))
        chosen = list(cols) or df.columns
        if len(chosen) != arity:
            raise ProgramError(f"{name} has {arity} attributes, not {len(chosen)}")
        flat = df.select(*chosen).toDF(*columns(arity))
        cast = [F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, _INTEGERS) else F.col(f.name) for f in flat.schema]
        self.bound[name] = flat.select(*cast).dropna().distinct() if arity else flat
        self.solved.clear()
        return self

    def add(self, name: str, rows: Iterable[tuple]) -> bool:
        """Adds tuples to a relation's input; says whether that changed it."""
        arity = len(self.relation_schema(name))
        new = self.spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{c} long" for c in columns(arity)))
        old = self.bound.get(name)
        if old is not None and new.join(old, columns(arity), "left_anti").isEmpty():
            return False
        self.bound[name] = (new if old is None else old.union(new)).distinct()
        self.solved.clear()
        return True

    def _load_inputs(self) -> None:
        for name, decl in self.program.relations.items():
            if name in self.bound or not decl.options & {"input", "inputtuples"}:
                continue
            base = os.path.join(self.program.basedir, name)
            kinds = [d for _, d in decl.attributes]
            try:
                if "inputtuples" in decl.options:
                    df = tuples.read_tuples(self.spark, base + ".tuples", [self.domains[d].size for d in kinds])
                else:
                    df = read_bdd(self.spark, base + ".bdd", kinds, {n: d.size for n, d in self.domains.items()}, os.path.join(self.program.basedir, "bddinfo"))
                self.bound[name] = df.distinct()
            except OSError:
                if self.strict_inputs:
                    raise
                self.program.warnings.append(f"no input file for {name}; it is empty")
                self.bound[name] = empty_frame(self.spark, decl.arity)

    # ---- solving

    def outputs(self) -> list[str]:
        """Relations that the program asks for, or all if it asks for none."""
        asked = [n for n, d in self.program.relations.items() if d.options & {"output", "outputtuples", "printtuples", "printsize"}]
        return asked or list(self.program.relations)

    def strata(self, outputs: list[str] | None = None, rules: list[Rule] | None = None) -> list[Stratum]:
        rules = split_rules(self.program, self.program.rules if rules is None else rules)
        given = set(self.bound) | {n for n, d in self.program.relations.items() if d.options & {"input", "inputtuples"}}
        wanted = outputs if outputs is not None else self.outputs()
        if outputs is None and wanted == list(self.program.relations):
            heads = {r.head.relation for r in rules}
            wanted = [n for n in wanted if n in heads or n in given]
        return stratify(self.program, rules, wanted, given)

    def solve(self, outputs: list[str] | None = None, rules: list[Rule] | None = None) -> dict[str, DataFrame]:
        """Values of all relations that the outputs need, by name."""
        self._load_inputs()
        known = {**self.bound}
        compiler = RuleCompiler(self.spark, self.program, self.domains, self.limit)
        options = self.options
        if self.program.settings.get("incremental") in ("no", "false"):
            options = replace(options, incremental=False)
        ev = Evaluator(self.spark, self.program, compiler, known, lambda n: empty_frame(self.spark, self.program.relations[n].arity), self.hooks, options)
        ev.run(self.strata(outputs, rules))
        self.rounds |= ev.rounds
        self.solved |= {n: df for n, df in ev.values.items()}
        return self.solved

    def relation(self, name: str) -> DataFrame:
        """A relation's rows with its attributes' names (repeated ones get a number)."""
        attributes = self.relation_schema(name)
        if name not in self.solved:
            heads = {h for r in self.program.rules for h in (r.head.relation, *r.modifies)}
            if name in heads or name in self.bound or self.program.relations[name].options & {"input", "inputtuples"}:
                self.solve([name])
            else:
                return empty_frame(self.spark, len(attributes)).toDF(*unique([a for a, _ in attributes]))
        return self.solved[name].toDF(*unique([a for a, _ in attributes]))

    def ranges(self, name: str) -> DataFrame:
        """The path numbers of a relation that one number rule makes, as ranges: an edge's two elements, n and shift (see number_ranges)."""
        rules = [r for r in self.program.rules if r.head.relation == name]
        if len(rules) != 1 or "number" not in rules[0].options or name in self.bound:
            raise ProgramError(f"{name} isn't made by one number rule alone")
        solved = self.solve(sorted({a.relation for a in rules[0].atoms()}))
        names = unique([a for a, _ in self.relation_schema(name)])[:2]
        return number_ranges(self.spark, rules[0], lambda a, i: solved[a.relation], self.options.number_graph).toDF(*names, "n", "shift")

    # ---- queries

    def query(self, text: str) -> DataFrame | dict[str, DataFrame]:
        """The rows of a conjunctive query, or all relations of a come-from query; the program stays as it was."""
        before = set(self.program.relations)
        found = self.parser.statement(text, 0)
        if not isinstance(found, Query):
            raise ProgramError(f"{text!r} is no query")
        self.program.queries.remove(found)
        try:
            return self.run_query(found)
        finally:
            for n in set(self.program.relations) - before:
                del self.program.relations[n]
                self.solved.pop(n, None)

    def run_query(self, query: Query) -> DataFrame | dict[str, DataFrame]:
        if query.come_from is not None:
            rules, names = come_from(self.program, query.come_from, query.single)
            validate(self.program, rules)
            solved = self.solve(names, [*self.program.rules, *rules])
            return {n: solved[n].toDF(*unique([a for a, _ in self.relation_schema(n)])) for n in names}
        rule = query.rule
        single = self.program.settings.get("singleignore")
        self.program.settings["singleignore"] = "yes"
        try:
            validate(self.program, [rule])
        finally:
            self.program.settings.pop("singleignore") if single is None else self.program.settings.__setitem__("singleignore", single)
        name = rule.head.relation
        solved = self.solve([name], [*self.program.rules, rule])
        return solved[name].toDF(*unique([a for a, _ in self.relation_schema(name)]))

    # ---- outputs

    def sizes(self, names: list[str] | None = None) -> DataFrame:
        """relation, size of each output."""
        names = names or self.outputs()
        out = None
        for n in names:
            one = self.relation(n).agg(F.count(F.lit(1)).alias("size")).select(F.lit(n).alias("relation"), "size")
            out = one if out is None else out.unionByName(one)
        return out

    def label_map(self, name: str) -> list[Domain | None]:
        return [self.domains.get(d) for _, d in self.relation_schema(name)]

    def show(self, name: str) -> str:
        """The size and up to 100 tuples of a relation as text."""
        return printing.tuples_text(name, self.relation(name), [a for a, _ in self.relation_schema(name)], self.label_map(name))

    def dot(self, spec: str) -> str:
        """The graph that a specification of the .dot directive describes, as text."""
        return dot.draw(self, dot.parse_spec(spec))

    def save(self, directory: str, run_hooks: bool = True) -> list[str]:
        """Writes the program's outputs: Parquet for output, tuple files for outputtuples; prints what it asks to print."""
        text = []
        for name, decl in self.program.relations.items():
            if "output" in decl.options:
                self.relation(name).toDF(*unique([a for a, _ in decl.attributes])).write.mode("overwrite").parquet(os.path.join(directory, f"{name}.parquet"))
            if "outputtuples" in decl.options:
                kinds = [(d, self.domains[d].size) if d in self.domains else (d, None) for _, d in decl.attributes]
                tuples.write_tuples(self.relation(name), os.path.join(directory, f"{name}.tuples"), kinds)
            if "printsize" in decl.options:
                text.append(f"SIZE OF {name}: {self.relation(name).count()}")
            if "printtuples" in decl.options:
                text.append(self.show(name))
        for q in self.program.queries:
            found = self.run_query(q)
            for n, df in (found.items() if isinstance(found, dict) else [(q.rule.head.relation, found)]):
                text.append(printing.tuples_text(n, df, df.columns, [None] * len(df.columns)))
        for spec in self.program.dots:
            with open(os.path.join(self.program.basedir, spec), encoding="utf-8") as file:
                parsed = dot.parse_spec(file.read())
            with open(os.path.join(directory, parsed.output or "graph.dot"), "w", encoding="utf-8") as file:
                file.write(dot.draw(self, parsed))
        for hook in self.save_hooks if run_hooks else ():
            hook(self)
        return text

    # ---- reading solved relations by pattern

    def matching(self, name: str, pattern: list[int | str | None]) -> DataFrame:
        """Rows that agree with a pattern in which None fits anything."""
        df = self.relation(name)
        for c, v in zip(df.columns, pattern):
            if v is not None:
                df = df.where(F.col(f"`{c}`") == v)
        return df

    def contains(self, name: str, column: int, value) -> bool:
        df = self.relation(name)
        return not df.where(F.col(f"`{df.columns[column]}`") == value).isEmpty()

    def column_values(self, name: str, column: int) -> DataFrame:
        df = self.relation(name)
        return df.select(f"`{df.columns[column]}`").distinct()

    def universe(self, name: str) -> DataFrame:
        """All tuples of a relation's domains, if they can be enumerated."""
        decl = self.program.relations[name]
        everything = Rule(Atom(name, tuple(_every() for _ in range(decl.arity))), [])
        return RuleCompiler(self.spark, self.program, self.domains, self.limit).compile(everything, lambda a, i: None).toDF(*unique([a for a, _ in decl.attributes]))

    def invert(self, name: str) -> DataFrame:
        """The complement of a relation."""
        df = self.relation(name)
        return self.universe(name).join(df, df.columns, "left_anti")


def _every():
    from datarill.plans.ast import Every

    return Every()


def unique(names: list[str]) -> list[str]:
    """Names made different from each other, as attributes may share one."""
    out: list[str] = []
    for n in names:
        k, name = 1, n
        while name.lower() in {o.lower() for o in out}:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out
