"""Update hooks: registered callables that see changes between rounds and may add rows.

A relation's block names a callable that is called with its new rows, and, if it
takes three arguments, with the rows before them; a rule's pre and post blocks name
callables that are called around its rounds. A hook returns a dict from relation to a
DataFrame of rows to add (columns by position), or None; what a pre block returns is
added at the end of its round. Program text is never executed: a block is a name that must
be registered.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from datarill.plans.ast import Program, ProgramError, Rule

Hook = Callable[..., dict[str, DataFrame] | None]


class Hooks:
    def __init__(self, registered: dict[str, Hook] | None = None, program: Program | None = None):
        self.registered, self.program = dict(registered or {}), program

    def _get(self, name: str) -> Hook:
        key = name.strip().rstrip(";").strip()
        if key not in self.registered:
            raise ProgramError(f"no callable is registered for the block {{{name}}}")
        return self.registered[key]

    def wanted(self, program: Program, rule: Rule) -> bool:
        return bool(rule.pre or rule.post)

    def _rows(self, block: str, found: dict[str, DataFrame] | None, growing: dict) -> Iterator[tuple[str, DataFrame]]:
        for target, rows in (found or {}).items():
            if target not in growing:
                raise ProgramError(f"the block {{{block}}} changes {target}, which no modifies option names")
            yield target, rows.toDF(*[f"_{i}" for i in range(len(rows.columns))]).distinct()

    def before(self, rule: Rule, read: Callable[[str], DataFrame], growing: dict) -> list[tuple[str, DataFrame]]:
        """(relation, rows) that the pre blocks of a rule add."""
        return [x for name in rule.pre for x in self._rows(name, self._get(name)(None, read), growing)]

    def after(self, stratum, growing: dict, read: Callable[[str], DataFrame]) -> Iterator[tuple[str, DataFrame]]:
        """(relation, rows) that the hooks of changed relations and of rules with changed heads add."""
        changed = [n for n in stratum.relations if growing[n].delta is not None]
        calls = [(n, self.program.relations[n].hook) for n in changed if self.program and self.program.relations[n].hook]
        calls += [(r.head.relation, p) for r in stratum.rules if r.head.relation in changed for p in r.post]
        for name, block in calls:
            hook = self._get(block)
            arguments = (growing[name].newest(), read, growing[name].older())
            yield from self._rows(block, hook(*arguments[: 3 if len(inspect.signature(hook).parameters) > 2 else 2]), growing)
