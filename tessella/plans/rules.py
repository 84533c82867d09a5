"""Rewrites that Catalyst lacks, on trees: join elimination, view subsumption, fusion of queries, cheap tests first."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from tessella.plans.tree import AlgebraError, Binary, Dedup, Filter, If, Join, Literal, Name, Query, Relation, Select, TupleOf, Unary, children, conjunction, conjuncts, rebuild


def fixpoint(rule, node: Any, limit: int = 100) -> Any:
    """The rule applied bottom-up until nothing changes."""
    for _ in range(limit):
        def deep(x):
            return rule(rebuild(x, deep))

        new = deep(node)
        if new == node:
            return node
        node = new
    raise AlgebraError("rewriting did not settle")


def simplify_test(e: Any) -> Any:
    """Constant parts of a predicate, with the rules of two-valued logic that hold for null as well."""
    if isinstance(e, Binary) and e.op in ("&&", "||"):
        a, b = e.left, e.right
        yes, no = Literal(True, "bool"), Literal(False, "bool")
        unit, zero = (yes, no) if e.op == "&&" else (no, yes)
        if a == unit:
            return b
        if b == unit:
            return a
        if zero in (a, b):
            return zero
        if a == b:
            return a
    if isinstance(e, Unary) and e.op == "not":
        if isinstance(e.arg, Literal) and isinstance(e.arg.value, bool):
            return Literal(not e.arg.value, "bool")
        if isinstance(e.arg, Unary) and e.arg.op == "not":
            return e.arg.arg
    if isinstance(e, If) and isinstance(e.test, Literal) and isinstance(e.test.value, bool):
        return e.then if e.test.value else e.other
    return e


def cost(e: Any) -> int:
    """String work is dear, the rest cheap."""
    own = 10 if isinstance(e, Binary) and e.op == "strpos" or isinstance(e, Unary) and e.op == "strlen" else 1
    if isinstance(e, Literal) and e.kind == "string":
        own = 4
    return own + sum(cost(c) for c in children(e))


def cheap_first(node: Any) -> Any:
    if isinstance(node, Filter):
        return replace(node, test=conjunction(sorted(conjuncts(node.test), key=cost)))
    return node


def drop_joins(node: Any) -> Any:
    """Under a distinct, a join side that only repeats the key it is joined on goes: its columns are equal to kept ones, and the distinct makes
    the multiplicity irrelevant. The other side keeps only rows whose key is there, so it must be a subset by construction."""
    if not (isinstance(node, Dedup) and isinstance(node.source, Select) and isinstance(node.source.source, Join)):
        return node
    sel, join = node.source, node.source.source
    pairs = [(t.left, t.right) for t in conjuncts(join.test) if isinstance(t, Binary) and t.op == "=" and isinstance(t.left, Name) and isinstance(t.right, Name)]
    if len(pairs) != len(conjuncts(join.test)) or not pairs:
        return node
    for side, other in (("left", join.right), ("right", join.left)):
        gone = getattr(join, side)
        if isinstance(gone, Dedup) and isinstance(gone.source, Select) and gone.source.source == other:
            names = {n: e for e, n in gone.source.items}
            of = {}
            for a, b in pairs:
                mine, theirs = (a, b) if a.column in names else (b, a)
                if names.get(mine.column) != theirs and names.get(mine.column) != Name(theirs.column):
                    return node
                of[mine.column] = theirs
            if set(names) <= set(of):
                def swap(x):
                    return of[x.column] if isinstance(x, Name) and x.column in of and x.scope is None else rebuild(x, swap)

                # the join leaves out null keys: k = k holds for all others
                kept = conjunction([Binary("=", k, k) for k in dict.fromkeys(of.values())])
                return Dedup(Select(tuple((swap(e), n) for e, n in sel.items), Filter(kept, other)))
    return node


def optimise(node: Any) -> Any:
    def rule(x: Any) -> Any:
        if isinstance(x, Dedup) and isinstance(x.source, Dedup):
            return x.source
        return drop_joins(cheap_first(simplify_test(x)))

    return fixpoint(rule, node)


def fuse(queries: list[Query], schemas: list[list[tuple[str, str]]]) -> Query:
    """Many queries as one with a query_id parameter: each is guarded by its number and padded to all columns."""
    every: dict[str, str] = {}
    for schema in schemas:
        for name, kind in schema:
            if every.setdefault(name, kind) != kind:
                raise AlgebraError(f"column {name} has two types")
    members, args = [], {"query_id": "int"}
    for i, (q, schema) in enumerate(zip(queries, schemas)):
        own = {n for n, _ in schema}
        for a, t in q.args:
            if args.setdefault(a, t) != t:
                raise AlgebraError(f"argument {a} has two types")
        blank = {"int": Literal(0, "int"), "fixed": Literal(0.0, "fixed"), "string": Literal("", "string"), "bool": Literal(False, "bool"), "date": Literal(None, "null", "date")}
        items = tuple((Name(n) if n in own else blank[t], n) for n, t in every.items())
        members.append(Select(items, Filter(Binary("=", Name("query_id"), Literal(i, "int")), q.body)))
    return Query("fused", tuple(args.items()), TupleOf(tuple(members), "concat"))


def subsumes(view: Any, query: Any) -> Any | None:
    """A select-filter query over the view's relation, answered from the view if its tests hold in the query and it has the columns that are
    needed; the rewritten query reads the relation ``view``."""

    def parts(x: Any):
        items, tests = None, []
        if isinstance(x, Select):
            items, x = x.items, x.source
        while isinstance(x, Filter):
            tests += conjuncts(x.test)
            x = x.source
        return items, tests, x

    vi, vt, vr = parts(view)
    qi, qt, qr = parts(query)
    if vr != qr or vi is None or not isinstance(vr, (Relation, Join)):
        return None
    if not set(vt) <= set(qt):
        return None
    have = {e: n for e, n in vi}

    def swap(e: Any):
        if e in have:
            return Name(have[e])
        if isinstance(e, Name):
            raise KeyError(e)
        return rebuild(e, swap)

    try:
        rest = [swap(t) for t in qt if t not in vt]
        source: Any = Relation("view")
        if rest:
            source = Filter(conjunction(rest), source)
        return Select(tuple((swap(e), n) for e, n in qi), source)
    except KeyError:
        return None


