"""Program text to Program: one tokenizer, one statement per logical line."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from .ast import Arg, Atom, Blank, Compare, Const, DomainDecl, Every, MapInto, Program, ProgramError, Query, RelationDecl, Rule, Term, Var

_TOKEN = re.compile(r"""\s*(?:(?P<string>"[^"]*")|(?P<code>\{[^}]*\})|(?P<op>:-|=>|<=|>=|!=|[()<>=!,.?*;~:])|(?P<word>(?:(?!:-)[^\s()<>=!,.?*;~:{}"])+))""")
_COMPARE = ("=", "!=", "<", "<=", ">", ">=")
#: Directives that switch something of ours, and those that tune what this engine has no part for.
SWITCHES = ("strict", "singleignore", "split_all_rules", "noisy", "trace", "report_stats", "incremental")
IGNORED = ("bddvarorder", "bddnodes", "bddcache", "bddminfree", "findbestorder")


def tokenize(text: str, line: int) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ProgramError(f"line {line}: can't read {text[at:].strip()[:30]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Cursor:
    def __init__(self, tokens: list[tuple[str, str]], line: int):
        self.tokens, self.at, self.line = tokens, 0, line

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        found = self.peek()
        if not found or wanted is not None and found != wanted:
            raise ProgramError(f"line {self.line}: expected {wanted or 'more'!r}, got {found or 'the end'!r}")
        self.at += 1
        return found

    def took(self, wanted: str) -> bool:
        if self.peek() == wanted:
            self.at += 1
            return True
        return False


def logical_lines(text: str) -> list[tuple[int, str]]:
    """Lines with their continuations; a block of code in braces belongs to its line."""
    out: list[tuple[int, str]] = []
    held, first = "", 0
    for number, line in enumerate(text.splitlines(), 1):
        if not held:
            first = number
        if line.rstrip().endswith("\\"):
            held += line.rstrip()[:-1] + " "
            continue
        held += line
        if held.count("{") > held.count("}") and not held.lstrip().startswith("#"):
            held += " "
            continue
        out.append((first, held))
        held = ""
    if held:
        out.append((first, held))
    return out


class Parser:
    """Reads statements into a program; ``read`` opens the files that .include names."""

    def __init__(self, program: Program | None = None, include_dirs: list[str] | None = None, read: Callable[[str], str] | None = None):
        self.program = program or Program()
        self.include_dirs = list(include_dirs or ["."])
        self._read = read or self._open
        self._depth = 0

    @staticmethod
    def _open(path: str) -> str:
        with open(path, encoding="utf-8", errors="replace") as file:
            return file.read()

    def on(self, switch: str) -> bool:
        return self.program.settings.get(switch, "no") not in ("no", "false")

    def parse(self, text: str) -> Program:
        for line, statement in logical_lines(text):
            self.statement(statement, line)
        return self.program

    def statement(self, text: str, line: int = 0):
        """Adds one statement; returns what it made."""
        text = text.strip()
        if not text or text.startswith("#"):
            return None
        if text.startswith("."):
            return self._directive(text, line)
        words = text.split()
        if len(words) > 1 and re.fullmatch(r"\d+", words[1]):
            return self._domain(words, line)
        tokens = tokenize(text, line)
        marks = [t for k, t in tokens if k == "op"]
        cursor = _Cursor(tokens, line)
        if "?" in marks and (marks[-1] == "?" or "." not in marks):
            return self._query(cursor)
        if ":-" in marks or "." in marks:
            return self._rule(cursor)
        return self._relation(cursor)

    # ---- declarations

    def _directive(self, text: str, line: int):
        name, _, rest = text[1:].partition(" ")
        rest = rest.strip()
        plain = rest[1:-1] if len(rest) > 1 and rest[0] == rest[-1] == '"' else rest
        if name == "include":
            if plain.startswith('"'):
                raise ProgramError(f"line {line}: unmatched quotes")
            path = next((p for d in self.include_dirs if os.path.exists(p := os.path.join(d, plain))), plain)
            self._depth += 1
            if self._depth > 50:
                raise ProgramError(f"line {line}: {plain} includes itself")
            try:
                self.parse(self._read(path))
            finally:
                self._depth -= 1
        elif name == "basedir":
            self.program.basedir = os.path.join(self.program.basedir, plain)
            self.include_dirs += [os.path.join(d, self.program.basedir) for d in self.include_dirs[:1]]
        elif name == "dot":
            self.program.dots.append(plain)
        elif name in SWITCHES:
            self.program.settings[name] = rest or "yes"
        elif name not in IGNORED:
            raise ProgramError(f"line {line}: unknown directive {text!r}")
        return None

    def _domain(self, words: list[str], line: int) -> DomainDecl:
        name = words[0]
        if name in self.program.domains:
            self.program.warnings.append(f"line {line}: domain {name} is declared already")
            return self.program.domains[name]
        found = self.program.domains[name] = DomainDecl(name, int(words[1]), words[2] if len(words) > 2 else None)
        return found

    def _domain_name(self, text: str, line: int) -> str:
        """A declared domain; trailing digits name one of its copies, which makes no difference here."""
        for name in (text, text.rstrip("0123456789")):
            if name in self.program.domains:
                return name
        raise ProgramError(f"line {line}: domain {text} isn't declared")

    def _relation(self, c: _Cursor) -> RelationDecl:
        name = c.take()
        if name in self.program.relations:
            raise ProgramError(f"line {c.line}: relation {name} is declared already")
        c.take("(")
        attributes = []
        while not c.took(")"):
            attribute = c.take()
            c.take(":")
            attributes.append((attribute, self._domain_name(c.take(), c.line)))
            if c.peek() != ")":
                c.take(",")
        found = RelationDecl(name, attributes)
        names = {a for a, _ in attributes}
        while c.peek():
            if c.kind() == "code":
                found.hook = c.take()[1:-1].strip()
                continue
            option = c.take()
            if option == "pri":
                c.take("=")
                found.priority = int(c.take())
            elif option in ("input", "inputtuples", "output", "outputtuples", "printtuples", "printsize"):
                found.options.add(option)
            elif option in names and c.peek() in ("=", "<"):
                c.take()
                if c.take() not in names:
                    raise ProgramError(f"line {c.line}: no such attribute in an order constraint of {name}")
            elif option != ",":
                raise ProgramError(f"line {c.line}: unknown relation option {option!r}")
        self.program.relations[name] = found
        return found

    # ---- rules

    def _argument(self, c: _Cursor) -> Arg:
        kind, text = c.kind(), c.take()
        if kind == "string":
            return Const(text[1:-1])
        if text == "*":
            return Every()
        if kind != "word":
            raise ProgramError(f"line {c.line}: expected a variable, got {text!r}")
        if text == "_":
            return Blank()
        if text[0].isdigit():
            if not text.isdigit():
                raise ProgramError(f"line {c.line}: {text!r} is no number")
            return Const(int(text))
        return Var(text)

    def _term(self, c: _Cursor) -> Term:
        negated = c.took("!")
        if c.kind() == "word" and c.peek(1) == "(":
            name = c.take()
            c.take("(")
            args: list[Arg] = []
            while not c.took(")"):
                args.append(self._argument(c))
                if c.peek() != ")":
                    c.take(",")
            return Atom(name, tuple(args), negated)
        if negated:
            raise ProgramError(f"line {c.line}: only relations can be negated")
        left = self._argument(c)
        op = c.take()
        right = self._argument(c)
        if op == "=>":
            if not (isinstance(left, Var) and isinstance(right, Var)):
                raise ProgramError(f"line {c.line}: both sides of => must be variables")
            return MapInto(left, right)
        if op not in _COMPARE:
            raise ProgramError(f"line {c.line}: unknown comparison {op!r}")
        if not all(isinstance(x, (Var, Const)) for x in (left, right)) or not any(isinstance(x, Var) for x in (left, right)):
            raise ProgramError(f"line {c.line}: a comparison needs a variable, and no _ or *")
        return Compare(left, op, right)

    def _rule(self, c: _Cursor) -> Rule:
        head = self._term(c)
        if not isinstance(head, Atom) or head.negated:
            raise ProgramError(f"line {c.line}: the head must be a plain relation")
        body: list[Term] = []
        if c.took(":-"):
            while True:
                body.append(self._term(c))
                if not c.took(","):
                    break
        c.take(".")
        rule = Rule(head, body, c.line)
        if self.on("split_all_rules"):
            rule.options.add("split")
        while c.peek():
            if c.kind() == "code":
                rule.post.append(c.take()[1:-1].strip())
                continue
            option = c.take()
            if option in ("split", "number", "single", "cacheafterrename", "findbestorder", "trace", "tracefull"):
                rule.options.add(option)
                if option == "findbestorder" and c.took("="):
                    c.take()
            elif option == "pri":
                c.take("=")
                rule.priority = int(c.take())
            elif option in ("pre", "post"):
                if c.kind() != "code":
                    raise ProgramError(f"line {c.line}: expected a block after {option}")
                (rule.pre if option == "pre" else rule.post).append(c.take()[1:-1].strip())
            elif option == "modifies":
                if c.took("("):
                    while not c.took(")"):
                        rule.modifies.append(c.take())
                        c.took(",")
                else:
                    rule.modifies.append(c.take())
            else:
                raise ProgramError(f"line {c.line}: unknown rule option {option!r}")
        self.program.rules.append(rule)
        return rule

    def _query(self, c: _Cursor) -> Query:
        first = self._term(c)
        terms: list[Term] = [first]
        if c.took(":-"):
            if not isinstance(first, Atom) or first.negated:
                raise ProgramError(f"line {c.line}: a come-from query begins with a plain relation")
            while not c.took("?"):
                self._term(c)
                c.took(",")
            single = c.took("single")
            if c.peek():
                raise ProgramError(f"line {c.line}: unknown query option {c.peek()!r}")
            found = Query(c.line, come_from=first, single=single)
        else:
            while c.took(","):
                terms.append(self._term(c))
            c.take("?")
            dropped: set[str] = set()
            while c.peek():
                if c.take() != "project":
                    raise ProgramError(f"line {c.line}: unknown query option")
                while not c.took(";"):
                    dropped.add(c.take())
            names = dict.fromkeys(v.name for t in terms for v in variables(t))
            shown = tuple(Var(n) for n in names if n not in dropped)
            found = Query(c.line, rule=Rule(Atom(f"query@{c.line}", shown), terms, c.line))
        self.program.queries.append(found)
        return found


def variables(term: Term) -> list[Var]:
    args = term.args if isinstance(term, Atom) else (term.left, term.right)
    return [a for a in args if isinstance(a, Var)]


def parse(text: str, include_dirs: list[str] | None = None) -> Program:
    """A program from its text, not yet validated."""
    return Parser(include_dirs=include_dirs).parse(text)
