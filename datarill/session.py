"""An interactive session: statements extend a program, queries are answered, commands inspect it."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from datarill.engine import Engine
from datarill.plans.ast import Atom, Blank, Compare, Const, Every, MapInto, ProgramError, Query, Rule, Var
from datarill.plans.validate import validate
from datarill.sources import printing

HELP = """\
relations            list the relations
rules                list the rules with their numbers
deleterule N{,N}     remove rules; what they derived stays until the next solve
solve                solve for the program's outputs
save R{,R}           write relations to the session's folder
printlog, dumplog    show the statements so far, or write them to session.log
exit                 leave
Anything else is a statement of a program; a statement that ends in ? is a query."""


def text_of(x) -> str:
    """A rule, term or argument as program text."""
    if isinstance(x, Rule):
        body = " :- " + ", ".join(map(text_of, x.body)) if x.body else ""
        return f"{text_of(x.head)}{body}." + "".join(f" {o}" for o in sorted(x.options))
    if isinstance(x, Atom):
        return ("!" if x.negated else "") + x.relation + "(" + ",".join(map(text_of, x.args)) + ")"
    if isinstance(x, Compare):
        return f"{text_of(x.left)} {x.op} {text_of(x.right)}"
    if isinstance(x, MapInto):
        return f"{text_of(x.left)} => {text_of(x.right)}"
    if isinstance(x, Const):
        return f'"{x.value}"' if isinstance(x.value, str) else str(x.value)
    return x.name if isinstance(x, Var) else "_" if isinstance(x, Blank) else "*" if isinstance(x, Every) else str(x)


class Session:
    def __init__(self, spark: SparkSession, engine: Engine | None = None, folder: str = "."):
        self.engine, self.folder, self.log = engine or Engine(spark), folder, []

    def run(self, line: str) -> str | None:
        """The answer to one line; None ends the session."""
        line = line.strip()
        command, _, rest = line.partition(" ")
        e = self.engine
        if command in ("exit", "quit"):
            return None
        if not line:
            return ""
        self.log.append(line)
        try:
            if command == "help":
                return HELP
            if line == "relations":
                return "\n".join(f"{n}({', '.join(f'{a}:{d}' for a, d in r.attributes)})" for n, r in e.program.relations.items())
            if line == "rules":
                return "\n".join(f"{i}: {text_of(r)}" for i, r in enumerate(e.program.rules, 1))
            if command == "deleterule":
                numbers = {int(x) for x in rest.split(",")}
                if not numbers <= set(range(1, len(e.program.rules) + 1)):
                    raise ProgramError("no such rule")
                e.program.rules[:] = [r for i, r in enumerate(e.program.rules, 1) if i not in numbers]
                return ""
            if line == "solve":
                e.solved.clear()
                e.solve()
                return "\n".join(f"SIZE OF {n}: {e.relation(n).count()}" for n in e.outputs() if "printsize" in e.program.relations[n].options)
            if command == "save":
                names = [n.strip() for n in rest.split(",")]
                for n in names:
                    e.relation(n).write.mode("overwrite").parquet(f"{self.folder}/{n}.parquet")
                return "saved " + ", ".join(names)
            if line == "printlog":
                return "\n".join(self.log[:-1])
            if line == "dumplog":
                with open(f"{self.folder}/session.log", "w", encoding="utf-8") as file:
                    file.write("\n".join(self.log[:-1]) + "\n")
                return f"Log dumped. ({len(self.log) - 1} lines)"
            found = e.parser.statement(line, len(self.log))
            if isinstance(found, Query):
                e.program.queries.remove(found)
                result = e.run_query(found)
                return "\n".join(printing.tuples_text(n, df, df.columns, [None] * len(df.columns)) for n, df in (result.items() if isinstance(result, dict) else [("query", result)]))
            if isinstance(found, Rule):
                try:
                    validate(e.program)
                except ProgramError:
                    e.program.rules.remove(found)
                    raise
                e.solved.clear()
            e._domains()
            return ""
        except (ProgramError, ValueError, OSError) as error:
            self.log.pop()
            return f"Invalid command. {error}"


def main(spark: SparkSession, source: TextIO = sys.stdin, out: TextIO = sys.stdout, folder: str = ".") -> None:
    session = Session(spark, folder=folder)
    out.write("> ")
    for line in source:
        answer = session.run(line)
        if answer is None:
            break
        out.write((answer + "\n" if answer else "") + "> ")
        out.flush()
