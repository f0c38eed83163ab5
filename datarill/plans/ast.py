"""What a program is made of."""

from __future__ import annotations

from dataclasses import dataclass, field


class ProgramError(ValueError):
    """A program that can't be accepted; says the line."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """An element number, or the name of an element."""

    value: int | str


@dataclass(frozen=True)
class Blank:
    """``_``: some value in a body, every value in a head."""


@dataclass(frozen=True)
class Every:
    """``*``: all values of the attribute's domain."""


Arg = Var | Const | Blank | Every


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Arg, ...]
    negated: bool = False


@dataclass(frozen=True)
class Compare:
    left: Var | Const
    op: str  # = != < <= > >=
    right: Var | Const


@dataclass(frozen=True)
class MapInto:
    """``a => b``: b is a's place among the elements added to b's domain."""

    left: Var
    right: Var


Term = Atom | Compare | MapInto


@dataclass
class DomainDecl:
    name: str
    size: int | None
    map_file: str | None = None


@dataclass
class RelationDecl:
    name: str
    attributes: list[tuple[str, str | None]]
    options: set[str] = field(default_factory=set)
    priority: int = 2
    hook: str | None = None
    inferred: bool = False

    @property
    def arity(self) -> int:
        return len(self.attributes)


@dataclass
class Rule:
    head: Atom
    body: list[Term]
    line: int = 0
    options: set[str] = field(default_factory=set)
    priority: int = 1
    modifies: list[str] = field(default_factory=list)
    pre: list[str] = field(default_factory=list)
    post: list[str] = field(default_factory=list)

    def atoms(self) -> list[Atom]:
        return [t for t in self.body if isinstance(t, Atom)]


@dataclass
class Query:
    """A conjunctive query's rule, or the parts of a come-from query."""

    line: int
    rule: Rule | None = None
    come_from: Atom | None = None
    single: bool = False


@dataclass
class Program:
    domains: dict[str, DomainDecl] = field(default_factory=dict)
    relations: dict[str, RelationDecl] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)
    settings: dict[str, str] = field(default_factory=dict)
    dots: list[str] = field(default_factory=list)
    basedir: str = ""
    warnings: list[str] = field(default_factory=list)
