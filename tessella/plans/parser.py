"""The text algebra: a tokenizer and a precedence-climbing parser."""

from __future__ import annotations

import datetime
import re
from typing import Any

from .tree import (
    Aggregate, AlgebraError, Binary, Bound, Dedup, DepJoin, Empty, Exists, Filter, First, GroupBy, HashIndex, If, Join, Limit, ListOf, Literal, Name, OrderBy, OrderedIndex, Query, Range, Relation, Scalar, Select, Substring, TupleOf, Unary,
)

_LEX = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<fixed>-?\d+\.\d+)|(?P<int>-?\d+)|(?P<string>"(?:\\.|[^"\\])*")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>&&|\|\||<=|>=|==|[-+*/%=<>(),.:\[\]{}])""",
    re.X,
)
RELATIONAL = {"select", "groupby", "filter", "depjoin", "join", "dedup", "orderby", "limit", "aempty", "ascalar", "alist", "atuple", "ahashidx", "aorderedidx", "range"}
AGGREGATES = {"sum", "avg", "min", "max"}
UNARY = {"day", "month", "year", "strlen", "to_year", "to_mon", "to_day"}
TYPES = {"int", "fixed", "string", "bool", "date"}
#: Binding strength; comparisons and arithmetic associate to the left, logic to the right.
LEVELS = ({"||"}, {"&&"}, {"=", "<", "<=", ">", ">="}, {"+", "-"}, {"*", "/", "%"})


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.tokens: list[tuple[str, str, int]] = []
        pos = 0
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m:
                raise AlgebraError(f"unexpected character {text[pos]!r} at {pos}")
            if m.lastgroup != "space":
                self._token(m)
            pos = m.end()
        self.tokens.append(("end", "", len(text)))

    def _token(self, m: re.Match) -> None:
        # a scope such as 0.f is an integer, a dot and a name
        self.tokens.append((m.lastgroup, m[0], m.start()))

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, text, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind, text.lower() if kind == "word" else text

    def fail(self, what: str):
        kind, text, pos = self.tokens[self.at]
        raise AlgebraError(f"expected {what} at {pos}, found {text or 'the end'!r}")

    def take(self, text: str) -> None:
        if self.peek()[1] != text or self.peek()[0] not in ("op", "word"):
            self.fail(repr(text))
        self.at += 1

    def maybe(self, text: str) -> bool:
        if self.peek()[1] == text and self.peek()[0] in ("op", "word"):
            self.at += 1
            return True
        return False

    def word(self, what: str = "a name") -> str:
        if self.peek()[0] != "word":
            self.fail(what)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def listed(self, item, close: str) -> list:
        out = []
        if self.maybe(close):
            return out
        while True:
            out.append(item())
            if self.maybe(close):
                return out
            self.take(",")

    def brackets(self, item) -> tuple:
        self.take("[")
        return tuple(self.listed(item, "]"))

    # relations
    def relation(self) -> Any:
        kind, word = self.peek()
        if kind != "word":
            self.fail("a relation")
        if word in RELATIONAL and (word == "aempty" or self.peek(1)[1] == "("):
            return self.operator()
        return Relation(self.word())

    def operator(self) -> Any:
        op = self.word().lower()
        if op == "aempty":
            return Empty()
        self.take("(")
        if op == "select":
            items = self.items()
            self.take(",")
            out = Select(items, self.relation())
        elif op == "groupby":
            items = self.items()
            self.take(",")
            keys = self.brackets(self.name)
            self.take(",")
            out = GroupBy(items, keys, self.relation())
        elif op == "filter":
            test = self.expr()
            self.take(",")
            out = Filter(test, self.relation())
        elif op == "join":
            test = self.expr()
            self.take(",")
            left = self.relation()
            self.take(",")
            out = Join(test, left, self.relation())
        elif op in ("depjoin", "alist"):
            left = self.relation()
            self.take(",")
            out = (DepJoin if op == "depjoin" else ListOf)(left, self.relation())
        elif op == "dedup":
            out = Dedup(self.relation())
        elif op == "orderby":
            keys = self.brackets(self.order)
            self.take(",")
            out = OrderBy(keys, self.relation())
        elif op == "limit":
            kind, n = self.peek()
            if kind != "int":
                self.fail("a number of rows")
            self.at += 1
            self.take(",")
            out = Limit(int(n), self.relation())
        elif op == "ascalar":
            e, n = self.item()
            out = Scalar(e, n)
        elif op == "atuple":
            members = self.brackets(self.relation)
            self.take(",")
            kind = self.word("cross, concat or zip").lower()
            if kind not in ("cross", "concat", "zip"):
                raise AlgebraError(f"unknown tuple kind {kind}")
            out = TupleOf(members, kind)
        elif op in ("ahashidx", "aorderedidx"):
            keys = self.relation()
            self.take(",")
            values = self.relation()
            self.take(",")
            out = HashIndex(keys, values, self.lookup()) if op == "ahashidx" else OrderedIndex(keys, values, self.bounds())
        else:
            low = self.expr()
            self.take(",")
            out = Range(low, self.expr())
        self.take(")")
        return out

    def items(self) -> tuple:
        items = self.brackets(self.item)
        names = [n for _, n in items]
        for n in names:
            if names.count(n) > 1:
                raise AlgebraError(f"duplicate name {n} in a select list")
        return items

    def item(self) -> tuple[Any, str]:
        e = self.expr()
        if self.maybe("as"):
            return e, self.word()
        if isinstance(e, Name):
            return e, e.column
        self.fail("'as'")

    def order(self) -> tuple[Any, bool]:
        e = self.expr()
        if self.maybe("desc"):
            return e, False
        self.maybe("asc")
        return e, True

    def lookup(self) -> tuple:
        if self.peek()[1] == "(":  # several keys, or one in parentheses
            mark = self.at
            self.at += 1
            try:
                many = tuple(self.listed(self.expr, ")"))
            except AlgebraError:
                many = ()
            if len(many) > 1 and self.peek()[1] == ")":
                return many
            self.at = mark
        return (self.expr(),)

    def bounds(self) -> tuple:
        out = []
        while True:
            lower = upper = None
            if self.peek()[1] != ",":
                closed = not self.maybe(">") if self.peek()[1] != ">=" else self.maybe(">=")
                lower = Bound(self.expr(), closed)
            self.take(",")
            if self.peek()[1] not in (",", ")"):
                closed = True if self.maybe("<=") else (self.maybe("<") and False)
                upper = Bound(self.expr(), closed)
            out.append((lower, upper))
            if not self.maybe(","):
                return tuple(out)

    # expressions
    def name(self) -> Name:
        kind, _ = self.peek()
        if kind == "int":
            scope = int(self.peek()[1])
            self.at += 1
            self.take(".")
            out = Name(self.word(), scope=scope)
        else:
            first = self.word()
            out = Name(self.word(), relation=first) if self.maybe(".") else Name(first)
        if self.peek()[1] == ":" and self.peek(1)[1] in TYPES:
            self.at += 2
        return out

    def expr(self) -> Any:
        if self.maybe("if"):
            test = self.binary(0)
            self.take("then")
            then = self.expr()
            self.take("else")
            return If(test, then, self.expr())
        return self.binary(0)

    def binary(self, level: int) -> Any:
        if level == len(LEVELS):
            return self.primary()
        left = self.binary(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in LEVELS[level]:
            op = self.peek()[1]
            self.at += 1
            left = Binary(op, left, self.binary(level if level < 2 else level + 1))
        return left

    def args(self, n: int) -> list:
        self.take("(")
        out = self.listed(self.expr, ")")
        if len(out) != n:
            raise AlgebraError(f"expected {n} arguments, found {len(out)}")
        return out

    def primary(self) -> Any:
        kind, word = self.peek()
        if kind == "fixed":
            self.at += 1
            return Literal(float(word), "fixed")
        if kind == "int":
            if self.peek(1)[1] == "." and self.peek(2)[0] == "word":
                return self.name()
            self.at += 1
            return Literal(int(word), "int")
        if kind == "string":
            self.at += 1
            return Literal(re.sub(r"\\(.)", r"\1", word[1:-1]), "string")
        if word == "(":
            if self.peek(1)[0] == "word" and self.peek(1)[1] in RELATIONAL and (self.peek(1)[1] == "aempty" or self.peek(2)[1] == "("):
                self.take("(")
                out = First(self.operator())
                self.take(")")
                return out
            self.take("(")
            out = self.expr()
            self.take(")")
            return out
        if kind != "word":
            self.fail("an expression")
        call = self.peek(1)[1] == "("
        if word in ("true", "false"):
            self.at += 1
            return Literal(word == "true", "bool")
        if word == "null":
            self.at += 1
            if self.peek()[1] == ":" and self.peek(1)[1] in TYPES:
                self.at += 2
                return Literal(None, "null", self.tokens[self.at - 1][1].lower())
            return Literal(None, "null")
        if word == "not":
            self.at += 1
            return Unary("not", self.primary())
        if word == "date" and call:
            self.at += 2
            kind, s = self.peek()
            if kind != "string":
                self.fail("a date string")
            self.at += 1
            self.take(")")
            return Literal(datetime.date.fromisoformat(s[1:-1]), "date")
        if call and word in ("count", "row_number"):
            self.at += 1
            self.args(0)
            return Aggregate(word)
        if call and word in AGGREGATES:
            self.at += 1
            return Aggregate(word, self.args(1)[0])
        if call and word in UNARY:
            self.at += 1
            return Unary(word, self.args(1)[0])
        if call and word == "strpos":
            self.at += 1
            return Binary("strpos", *self.args(2))
        if call and word == "substring":
            self.at += 1
            return Substring(*self.args(3))
        if call and word == "exists":
            self.at += 2
            out = Exists(self.relation())
            self.take(")")
            return out
        return self.name()

    def query(self) -> Query:
        self.take("query")
        name = self.word()
        self.take("(")

        def arg():
            n = self.word()
            self.take(":")
            return n, self.word("a type").lower()

        args = tuple(self.listed(arg, ")"))
        self.take("{")
        body = self.relation()
        self.take("}")
        return Query(name, args, body)


def parse(text: str) -> Any:
    """A relation, or a named query with arguments."""
    p = Parser(text)
    out = p.query() if p.peek() == ("word", "query") and p.peek(2)[1] == "(" else p.relation()
    if p.peek()[0] != "end":
        p.fail("the end")
    return out
