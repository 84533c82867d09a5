"""Algebra to DataFrames.

Every relation is built in a context: the columns of the enclosing binders. A relation that uses none of them is built by itself. One that does
carries the context's columns with it, operator by operator, so that a dependent join never becomes a loop: filters and joins meet the context in
an ordinary join whose condition Catalyst splits into keys, aggregates group by the context as well, and a global aggregate is joined
back to the context so that empty groups keep their row. Only where multiplicities matter (aggregates, distinct, limits) the context is first made
distinct. Layout operators are dependent joins over their keys.
"""

from __future__ import annotations

import datetime
import itertools
import tempfile
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.plans.tree import (
    Aggregate, AlgebraError, Binary, Dedup, DepJoin, Empty, Exists, Filter, First, GroupBy, HashIndex, If, Join, Limit, ListOf, Literal, Name, One, OrderBy, OrderedIndex, Range, Relation, Scalar, Select, Substring, TupleOf, Unary, children, conjunction, conjuncts, has_aggregate, has_window, rebuild,
)

_FRESH = itertools.count()


def fresh(name: str = "c") -> str:
    return f"__{name}_{next(_FRESH)}"


@dataclass(frozen=True)
class Col:
    """A column of a relation: its name, the relation it comes from, and its unique name in the DataFrame."""

    name: str
    relation: str | None
    own: str


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    cols: tuple[Col, ...]
    context: tuple[str, ...] = ()  # columns of the context that df carries
    date: frozenset[str] = frozenset()  # midnight timestamps that are dates


@dataclass(frozen=True)
class Scope:
    """An enclosing binder's columns, or (subquery) the row that a subquery is evaluated for."""

    cols: tuple[Col, ...]
    binder: bool


@dataclass(frozen=True)
class Context:
    """The enclosing scopes, innermost first, and a DataFrame with all their columns."""

    scopes: tuple[Scope, ...] = ()
    df: DataFrame | None = None
    keys: tuple[str, ...] = ()


NONE = Context()


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one that spark.checkpoint.dir names; a local one only where everything runs in one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise AlgebraError("row_number() needs spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="tessella-")
    sc.setCheckpointDir(folder)


def find(cols: tuple[Col, ...], n: Name) -> Col | None:
    own = [c for c in cols if c.name == n.column and (n.relation is None or c.relation == n.relation)]
    if len(own) > 1:
        raise AlgebraError(f"ambiguous name {n.column}")
    return own[0] if own else None


class Builder:
    def __init__(self, spark: SparkSession, catalog, params: dict[str, Any] | None = None):
        self.spark, self.catalog, self.params = spark, catalog, params or {}

    # names and expressions
    def outer(self, n: Name, ctx: Context) -> Col | None:
        if n.scope is not None:
            binders = [s for s in ctx.scopes if s.binder]
            if n.scope >= len(binders):
                raise AlgebraError(f"no enclosing binder {n.scope} for {n.column}")
            c = find(binders[n.scope].cols, replace(n, scope=None))
            if not c:
                raise AlgebraError(f"unbound name {n.scope}.{n.column}")
            return c
        for s in ctx.scopes:
            if not s.binder and (c := find(s.cols, n)):
                return c
        return None

    def schema(self, node: Any) -> tuple[Col, ...]:
        """The names that a relation's columns have, as far as they are known without building it."""
        if isinstance(node, Relation):
            return tuple(Col(c, node.name, c) for c in self.catalog.table(self.spark, node.name)[0].columns)
        if isinstance(node, (Select, GroupBy)):
            return tuple(Col(n, None, n) for _, n in node.items)
        if isinstance(node, (Filter, Dedup, OrderBy, Limit)):
            return self.schema(node.source)
        if isinstance(node, Join):
            return self.schema(node.left) + self.schema(node.right)
        if isinstance(node, (DepJoin, ListOf)):
            return self.schema(node.right if isinstance(node, DepJoin) else node.values)
        if isinstance(node, Scalar):
            return (Col(node.name, None, node.name),)
        return ()

    def used(self, node: Any, ctx: Context, inner: tuple[Col, ...] = ()) -> set[str]:
        """The context's columns that a tree uses. A name that a relation below it (or ``inner``) has is that relation's."""
        out: set[str] = set()

        def has(cols: tuple[Col, ...], n: Name) -> bool:
            return any(c.name == n.column and (n.relation is None or c.relation == n.relation) for c in cols)

        def walk(x: Any, depth: int, below: tuple[Col, ...]) -> None:
            if isinstance(x, Name):
                if x.scope is not None:
                    if x.scope >= depth:
                        c = self.outer(replace(x, scope=x.scope - depth), ctx)
                        out.add(c.own)
                elif not has(below, x) and (c := self.outer(x, ctx)):
                    out.add(c.own)
                return
            if isinstance(x, (DepJoin, ListOf, HashIndex, OrderedIndex)):
                first, second = (x.left, x.right) if isinstance(x, DepJoin) else (x.keys, x.values)
                walk(first, depth, below)
                walk(second, depth + 1, below)
                for y in children(x):
                    if y is not first and y is not second:
                        walk(y, depth, below)
                return
            own = below
            if isinstance(x, (Select, GroupBy, Filter, OrderBy)):
                own = below + self.schema(x.source)
                if isinstance(x, Filter) and isinstance(x.source, GroupBy):
                    own += self.schema(x.source.source)  # HAVING sees both
            elif isinstance(x, Join):
                own = below + self.schema(x.left) + self.schema(x.right)
            for y in children(x):
                source = any(y is z for z in (getattr(x, "source", None), getattr(x, "left", None), getattr(x, "right", None)) if z is not None)
                walk(y, depth, below if source and own is not below else own)

        walk(node, 0, inner)
        return out

    def expr(self, e: Any, rel: Rel, ctx: Context, subs: dict[Any, Column] | None = None) -> Column:
        go = lambda x: self.expr(x, rel, ctx, subs)
        if subs and e in subs:
            return subs[e]
        if isinstance(e, Literal):
            return scalars.literal(e)
        if isinstance(e, Name):
            if e.scope is None and (c := find(rel.cols, e)):
                return F.col(c.own)
            if c := self.outer(e, ctx):
                return F.col(c.own)
            if e.relation is None and e.column in self.params:
                v = self.params[e.column]
                return v if isinstance(v, Column) else F.lit(v)
            raise AlgebraError(f"unbound name {e.column}")
        if isinstance(e, Binary):
            if e.op in "+-" and isinstance(e.right, Unary) and e.right.op in scalars.INTERVALS:
                return scalars.interval(e.op, go(e.left), e.right.op, go(e.right.arg))
            if e.op in "+-" and self.is_date(e.left, rel, ctx) and not self.is_date(e.right, rel, ctx):
                return scalars.interval(e.op, go(e.left), "day", go(e.right))
            return scalars.binary(e.op, go(e.left), go(e.right))
        if isinstance(e, Unary):
            return scalars.unary(e.op, go(e.arg))
        if isinstance(e, If):
            return F.when(go(e.test), go(e.then)).otherwise(go(e.other))
        if isinstance(e, Substring):
            return scalars.substring(go(e.text), go(e.start), go(e.length))
        if isinstance(e, Aggregate):
            if e.op == "count":
                return F.count(F.lit(1))
            if e.op == "row_number":
                raise AlgebraError("row_number() only as an item of a select list")
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.op](go(e.arg))
        raise AlgebraError(f"not an expression here: {type(e).__name__}")

    def is_date(self, e: Any, rel: Rel, ctx: Context) -> bool:
        if isinstance(e, Literal):
            return e.kind == "date"
        if isinstance(e, Name):
            c = (find(rel.cols, e) if e.scope is None else None) or self.outer(e, ctx)
            if c:
                kinds = dict(rel.df.dtypes) | (dict(ctx.df.dtypes) if ctx.df is not None else {})
                return kinds.get(c.own) in ("date", "timestamp", "timestamp_ntz")
            return isinstance(self.params.get(e.column), datetime.date)
        return isinstance(e, Binary) and e.op in "+-" and self.is_date(e.left, rel, ctx)

    # contexts
    def lift(self, rel: Rel, ctx: Context, need: bool) -> Rel:
        """rel with the context's columns, if they are needed and not there."""
        if rel.context or not need or ctx.df is None:
            return rel
        return replace(rel, df=ctx.df.join(rel.df), context=ctx.keys)

    def distinct(self, ctx: Context, used: set[str]) -> tuple[Context, dict[str, str]]:
        """The distinct values of the used columns as a context of new columns."""
        to = {k: fresh("d") for k in ctx.keys if k in used}
        df = ctx.df.select(*[F.col(k).alias(v) for k, v in to.items()]).distinct()
        scopes = tuple(Scope(tuple(replace(c, own=to[c.own]) for c in s.cols if c.own in to), s.binder) for s in ctx.scopes)
        return Context(scopes, df, tuple(to.values())), to

    def grouped(self, node: Any, ctx: Context) -> Rel:
        """A relation in which the context's multiplicities matter: built over the distinct context, then joined back."""
        used = self.used(node, ctx)
        if ctx.df is None or not used:
            return self.plain(node, ctx)
        small, to = self.distinct(ctx, used)
        rel = self.plain(node, small)
        rel = self.lift(rel, small, True)
        same = [F.col(k).eqNullSafe(F.col(v)) for k, v in to.items()]
        on = same[0]
        for s in same[1:]:
            on = on & s
        df = ctx.df.join(rel.df, on)
        return replace(rel, df=df.drop(*to.values()), context=ctx.keys)

    # relations
    def build(self, node: Any, ctx: Context = NONE) -> Rel:
        matters = isinstance(node, (Dedup, GroupBy, Limit)) or (isinstance(node, Select) and any(has_aggregate(e) or has_window(e) for e, _ in node.items))
        if isinstance(node, Join) and ctx.df is not None and self.used(node.left, ctx) and self.used(node.right, ctx):
            matters = True  # both sides carry the context and meet on it
        return self.grouped(node, ctx) if matters else self.plain(node, ctx)

    def plain(self, node: Any, ctx: Context) -> Rel:
        return getattr(self, "_" + type(node).__name__.lower())(node, ctx)

    def _relation(self, node: Relation, ctx: Context) -> Rel:
        df, dates = self.catalog.table(self.spark, node.name)
        cols = tuple(Col(c, node.name, fresh(c)) for c in df.columns)
        return Rel(df.select(*[F.col(f"`{c.name}`").alias(c.own) for c in cols]), cols, date=frozenset(c.own for c in cols if c.name in dates))

    def with_subqueries(self, es: list[Any], rel: Rel, ctx: Context) -> tuple[Rel, dict[Any, Column]]:
        """rel with a column for each subquery of the expressions: one join each, on the distinct values that the subquery uses."""
        subs: dict[Any, Column] = {}

        def gather(e: Any):
            if isinstance(e, (Exists, First)):
                yield e
            else:
                for c in children(e):
                    yield from gather(c)

        for q in dict.fromkeys(q for e in es for q in gather(e)):
            rel, value = self.subquery(q, rel, ctx)
            subs[q] = value
        return rel, subs

    def _peel(self, node: Any, here: Context) -> tuple[Rel, list[Any], Any] | None:
        """A filter chain over an uncorrelated relation: that relation with the uncorrelated tests, the correlated tests, and its tree. None if the
        correlation lies deeper or names a binder."""
        tests: list[Any] = []
        while isinstance(node, Filter) and not (isinstance(node.source, GroupBy) and has_aggregate(node.test)):
            tests += conjuncts(node.test)
            node = node.source
        if self.used(node, here):
            return None
        cols = self.schema(node)
        if not cols:
            return None
        own = [t for t in tests if not self.used(t, here, cols)]
        corr = [t for t in tests if self.used(t, here, cols)]
        if any(any(True for _ in self._subqueries(t)) or any(isinstance(x, Name) and x.scope is not None for x in _walk(t)) for t in corr):
            return None
        return self.build(Filter(conjunction(own), node) if own else node, NONE), corr, node

    def _equal(self, t: Any, inner: tuple[Col, ...], here: Context) -> tuple[Any, Any] | None:
        """(inner side, outer side) of an equality between them."""
        if not (isinstance(t, Binary) and t.op == "="):
            return None

        def inside(e: Any) -> bool:
            return not self.used(e, here, inner)

        def outside(e: Any) -> bool:
            return not any(isinstance(x, Name) and find(inner, x) for x in _walk(e))

        for a, b in ((t.left, t.right), (t.right, t.left)):
            if inside(a) and outside(b):
                return a, b
        return None

    def _here(self, rel: Rel, ctx: Context) -> Context:
        return Context((Scope(rel.cols, False), *ctx.scopes), rel.df, tuple(dict.fromkeys((*[c.own for c in rel.cols], *rel.context))))

    def _semi(self, q: Exists, rel: Rel, ctx: Context, how: str) -> Rel | None:
        """exists as one semi or anti join on the subquery's own correlated tests, where it has this form."""
        node = q.query
        while isinstance(node, (Dedup, OrderBy)) or isinstance(node, Select) and not any(has_aggregate(e) or has_window(e) or any(True for _ in self._subqueries(e)) for e, _ in node.items):
            node = node.source
        here = self._here(rel, ctx)
        found = self._peel(node, here)
        if not found or not found[1]:
            return None
        inner, corr, _ = found
        on = None
        for t in corr:
            c = self._test(t, replace(inner, df=None), inner, rel, here)
            on = c if on is None else on & c
        return replace(rel, df=rel.df.join(inner.df, on, how))

    def _lookup(self, q: First, rel: Rel, ctx: Context) -> tuple[Rel, Column] | None:
        """A scalar subquery correlated by equalities: its relation is grouped by its side of them and joined once."""
        node = q.query
        if not (isinstance(node, Select) and len(node.items) == 1):
            return None
        e = node.items[0][0]
        here = self._here(rel, ctx)
        if has_window(e) or any(True for _ in self._subqueries(e)):
            return None
        found = self._peel(node.source, here)
        if not found or not found[1] or self.used(e, here, found[0].cols) or any(isinstance(x, Name) and x.scope is not None for x in _walk(e)):
            return None
        inner, corr, _ = found
        pairs = [self._equal(t, inner.cols, here) for t in corr]
        if None in pairs:
            return None
        keys = [fresh("k") for _ in pairs]
        x, name, count = self.expr(e, inner, NONE), fresh("q"), fresh("n")
        value = x if has_aggregate(e) else F.first(x)
        grouped = inner.df.groupBy(*[self.expr(a, inner, NONE).alias(k) for (a, _), k in zip(pairs, keys)]).agg(value.alias(name), F.count(F.lit(1)).alias(count))
        on = None
        for (_, b), k in zip(pairs, keys):
            c = F.col(k) == self.expr(b, Rel(rel.df, ()), here)
            on = c if on is None else on & c
        out = F.col(name)
        if not has_aggregate(e):
            out = F.when(F.col(count) > 1, F.raise_error(F.lit("a scalar subquery gave more than one row"))).otherwise(out)
        elif (blank := self._blank(e)) is not None:
            out = F.when(F.col(count).isNull(), blank).otherwise(out)
        return replace(rel, df=rel.df.join(grouped, on, "left").drop(*keys)), out

    def subquery(self, q: Any, rel: Rel, ctx: Context) -> tuple[Rel, Column]:
        outer_used = self.used(q.query, ctx)
        rel = self.lift(rel, ctx, bool(outer_used))
        if isinstance(q, First) and (found := self._lookup(q, rel, ctx)):
            return found
        scope = Scope(rel.cols, False)
        inner = Context((scope, *ctx.scopes), rel.df, tuple(dict.fromkeys((*[c.own for c in rel.cols], *rel.context))))
        used = self.used(q.query, inner)
        name = fresh("q")
        if not used:
            r = self.build(q.query, NONE)
            one = self.single(r, q, [], name)
            df = rel.df.join(F.broadcast(one))  # one row
        else:
            small, to = self.distinct(inner, used)
            r = self.lift(self.build(q.query, small), small, True)
            one = self.single(r, q, list(to.values()), name)
            on = None
            for k, v in to.items():
                c = F.col(k).eqNullSafe(F.col(v))
                on = c if on is None else on & c
            df = rel.df.join(one, on, "left").drop(*to.values())
        value = F.col(name)
        if isinstance(q, Exists):
            value = F.coalesce(value, F.lit(False))
        return replace(rel, df=df), value

    def single(self, r: Rel, q: Any, keys: list[str], name: str) -> DataFrame:
        """One row for each key: whether there are rows, or the one value (more than one is an error)."""
        if isinstance(q, Exists):
            if keys:
                return r.df.select(*keys).distinct().withColumn(name, F.lit(True))
            return r.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
        if len(r.cols) != 1:
            raise AlgebraError("a scalar subquery has one column")
        c = F.col(r.cols[0].own)
        n = F.count(F.lit(1))
        value = F.when(n > 1, F.raise_error(F.lit("a scalar subquery gave more than one row"))).otherwise(F.first(c)).alias(name)
        return r.df.groupBy(*keys).agg(value) if keys else r.df.agg(value)

    def _filter(self, node: Filter, ctx: Context) -> Rel:
        if isinstance(node.source, GroupBy) and has_aggregate(node.test):  # HAVING over the group-by below
            return self._having(node, ctx)
        if has_aggregate(node.test) or has_window(node.test):
            raise AlgebraError("no aggregate in a filter")
        rel = self.build(node.source, ctx)
        plain, tests = [], []
        for t in conjuncts(node.test):
            (tests if any(True for _ in self._subqueries(t)) else plain).append(t)
        if plain:
            need = any(self.used(t, ctx) - {c.own for c in rel.cols} for t in plain)
            cond = None
            for t in plain:
                c = self.expr(t, rel, ctx)
                cond = c if cond is None else cond & c
            if need and not rel.context and ctx.df is not None:
                rel = replace(rel, df=ctx.df.join(rel.df, cond), context=ctx.keys)  # an ordinary join
            else:
                rel = replace(rel, df=rel.df.where(cond))
        for t in tests:
            rel = self._subquery_filter(t, rel, ctx)
        return rel

    def _subqueries(self, e: Any):
        if isinstance(e, (Exists, First)):
            yield e
        else:
            for c in children(e):
                yield from self._subqueries(c)

    def _subquery_filter(self, t: Any, rel: Rel, ctx: Context) -> Rel:
        inner, how = t, "left_semi"
        if isinstance(t, Unary) and t.op == "not":
            inner, how = t.arg, "left_anti"
        if isinstance(inner, Exists):  # a semi or anti join
            outer_used = self.used(inner.query, ctx)
            rel = self.lift(rel, ctx, bool(outer_used))
            if joined := self._semi(inner, rel, ctx, how):
                return joined
            here = self._here(rel, ctx)
            used = self.used(inner.query, here)
            if used:
                small, to = self.distinct(here, used)
                r = self.lift(self.build(inner.query, small), small, True)
                on = None
                for k, v in to.items():
                    c = F.col(k).eqNullSafe(F.col(v))
                    on = c if on is None else on & c
                return replace(rel, df=rel.df.join(r.df.select(*to.values()), on, how))
        rel, subs = self.with_subqueries([t], rel, ctx)
        keep = [c.own for c in rel.cols] + [k for k in rel.context]
        rel = self.lift(rel, ctx, bool(self.used(t, ctx) - {c.own for c in rel.cols}))
        return replace(rel, df=rel.df.where(self.expr(t, rel, ctx, subs)).select(*dict.fromkeys([*keep, *rel.context])))

    def _having(self, node: Filter, ctx: Context) -> Rel:
        own, extra = node.source, []

        def name(e: Any) -> Any:
            if isinstance(e, Aggregate):
                n = fresh("h")
                extra.append((e, n))
                return Name(n)
            return e if isinstance(e, (Exists, First)) else rebuild(e, name)

        test = name(node.test)
        rel = self._filter(Filter(test, replace(own, items=own.items + tuple(extra))), ctx)
        gone = {n for _, n in extra}
        return replace(rel, cols=tuple(c for c in rel.cols if c.name not in gone))

    def _select(self, node: Select, ctx: Context) -> Rel:
        es = [e for e, _ in node.items]
        if any(has_aggregate(e) for e in es):
            return self._aggregate(node.items, (), node.source, ctx)
        rel = self.build(node.source, ctx)
        rel, subs = self.with_subqueries(es, rel, ctx)
        need = any(self.used(e, ctx) - {c.own for c in rel.cols} for e in es)
        rel = self.lift(rel, ctx, need)
        cols, out, dates = [], [], set()
        for e, n in node.items:
            own = fresh(n)
            if isinstance(e, Aggregate) and e.op == "row_number":
                rel = self._numbered(rel, own)
                out.append(F.col(own))
            else:
                out.append(self.expr(e, rel, ctx, subs).alias(own))
                if isinstance(e, Name) and (c := (find(rel.cols, e) if e.scope is None else None)) and c.own in rel.date:
                    dates.add(own)
            cols.append(Col(n, None, own))
        return Rel(rel.df.select(*rel.context, *out), tuple(cols), rel.context, frozenset(dates) | (rel.date & set(rel.context)))

    def _numbered(self, rel: Rel, own: str) -> Rel:
        """Row numbers without one task for all rows: numbers within partitions, plus the rows of the partitions before. The rows are written to
        the checkpoint folder once, so that numbers and counts see the same partitions whatever the optimiser does."""
        if rel.context:
            w = Window.partitionBy(*rel.context).orderBy(F.lit(1))
            return replace(rel, df=rel.df.withColumn(own, F.row_number().over(w).cast("bigint")))
        mid, part, before = fresh("m"), fresh("p"), fresh("b")
        checkpoint_folder(self.spark)
        df = rel.df.checkpoint().withColumn(mid, F.monotonically_increasing_id()).withColumn(part, F.shiftright(mid, 33))
        n = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
        n = n.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
        df = df.join(F.broadcast(n), part).withColumn(own, F.col(before) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)) + 1)  # a row for each partition
        return replace(rel, df=df.drop(mid, part, before))

    def _groupby(self, node: GroupBy, ctx: Context) -> Rel:
        return self._aggregate(node.items, node.keys, node.source, ctx)

    def _aggregate(self, items, keys, source, ctx: Context) -> Rel:
        rel = self.build(source, ctx)
        rel, subs = self.with_subqueries([e for e, _ in items], rel, ctx)
        need = any(self.used(e, ctx) - {c.own for c in rel.cols} for e in [*[e for e, _ in items], *keys])
        correlated = bool(rel.context) or need
        rel = self.lift(rel, ctx, need)
        by = [find(rel.cols, k) or self.outer(k, ctx) for k in keys]
        if None in by:
            raise AlgebraError(f"unbound name {keys[by.index(None)].column}")
        keyed = {c.own for c in by} | set(rel.context)
        cols, out, dates = [], [], set()
        passed = []
        for e, n in items:
            own = fresh(n)
            if isinstance(e, Name) and (c := (find(rel.cols, e) if e.scope is None else None) or self.outer(e, ctx)) and c.own in keyed:
                passed.append(F.col(c.own).alias(own))
                if c.own in rel.date:
                    dates.add(own)
            else:
                x = self.expr(e, rel, ctx, subs)
                if not has_aggregate(e):
                    x = F.min(x)  # a bare scalar: one of the group's values, always the same
                out.append(x.alias(own))
                passed.append(F.col(own))
            cols.append(Col(n, None, own))
        group = [*rel.context, *[c.own for c in by if c.own not in rel.context]]
        if not group:
            return Rel(rel.df.agg(*out).select(*passed) if out else rel.df.limit(1).select(*passed), tuple(cols), (), frozenset(dates))
        df = rel.df.groupBy(*group).agg(*out) if out else rel.df.select(*group).distinct()
        if correlated and not keys:  # empty groups keep their row
            to = {k: fresh("k") for k in rel.context}
            df = df.select(*[F.col(c).alias(to.get(c, c)) for c in df.columns])
            hit = fresh("hit")
            df = df.withColumn(hit, F.lit(True))
            on = None
            for k, v in to.items():
                c = F.col(k).eqNullSafe(F.col(v))
                on = c if on is None else on & c
            df = ctx.df.select(*rel.context).join(df, on, "left")
            for (e, n), c in zip(items, cols):
                if has_aggregate(e):
                    blank = self._blank(e)
                    if blank is not None:
                        df = df.withColumn(c.own, F.when(F.col(hit), F.col(c.own)).otherwise(blank.cast(df.schema[c.own].dataType)))
            df = df.drop(*to.values(), hit)
        return Rel(df.select(*rel.context, *passed), tuple(cols), rel.context, frozenset(dates))

    def _blank(self, e: Any) -> Column | None:
        """An aggregate expression's value over no rows, where it is not null."""
        if not any(isinstance(x, Aggregate) and x.op == "count" for x in _walk(e)):
            return None

        def swap(x: Any) -> Any:
            if isinstance(x, Aggregate):
                return Literal(0, "int") if x.op == "count" else Literal(None, "null", "fixed")
            return rebuild(x, swap)

        new = swap(e)
        if any(isinstance(x, Name) for x in _walk(new)):
            return None
        return self.expr(new, Rel(None, ()), NONE)

    def _join(self, node: Join, ctx: Context) -> Rel:
        left, right = self.build(node.left, ctx), self.build(node.right, ctx)
        names = {c.name for c in left.cols} & {c.name for c in right.cols} - {"dummy"}
        clash = {c.name for c in left.cols if c.name in names and any(d.name == c.name and d.relation == c.relation for d in right.cols)}
        if clash:
            raise AlgebraError(f"both sides of a join have {sorted(clash)}")
        both = Rel(None, left.cols + right.cols)
        on = None
        if left.context and right.context:
            to = {k: fresh("r") for k in right.context}
            right = replace(right, df=right.df.select(*[F.col(c).alias(to.get(c, c)) for c in right.df.columns]))
            for k, v in to.items():
                c = F.col(k).eqNullSafe(F.col(v))
                on = c if on is None else on & c
        else:
            to = {}
        need = bool(self.used(node.test, ctx) - {c.own for c in both.cols})
        if need and not left.context and not right.context:
            left = self.lift(left, ctx, True)
        context = left.context or right.context
        if any(True for _ in self._subqueries(node.test)):
            rel = Rel(left.df.join(right.df, on).drop(*to.values()) if on is not None else left.df.join(right.df), both.cols, context, left.date | right.date)
            return self._subquery_filter(node.test, rel, ctx)
        both = replace(both, df=left.df)
        test = None if node.test == Literal(True, "bool") else self._test(node.test, both, left, right, ctx)
        if test is not None:
            on = test if on is None else on & test
        df = left.df.join(right.df, on) if on is not None else left.df.crossJoin(right.df)
        return Rel(df.drop(*to.values()), both.cols, context, left.date | right.date)

    def _test(self, e: Any, both: Rel, left: Rel, right: Rel, ctx: Context) -> Column:
        kinds = dict(left.df.dtypes) | dict(right.df.dtypes)
        own = self

        class Typed(Builder):
            def is_date(self, e, rel, ctx):
                if isinstance(e, Name) and e.scope is None and (c := find(rel.cols, e)):
                    return kinds.get(c.own) in ("date", "timestamp", "timestamp_ntz")
                return own.is_date(e, left, ctx)

        return Typed(self.spark, self.catalog, self.params).expr(e, both, ctx)

    def _dedup(self, node: Dedup, ctx: Context) -> Rel:
        rel = self.build(node.source, ctx)
        return replace(rel, df=rel.df.select(*rel.context, *[c.own for c in rel.cols]).distinct())

    def _orderby(self, node: OrderBy, ctx: Context) -> Rel:
        rel = self.build(node.source, ctx)
        keys = [(e, up) for e, up in node.keys if not isinstance(e, Literal)]
        if not keys or rel.context or ctx.df is not None:
            return rel  # order below a dependent join has no meaning
        return replace(rel, df=rel.df.orderBy(*[(self.expr(e, rel, ctx).asc() if up else self.expr(e, rel, ctx).desc()) for e, up in keys]))

    def _limit(self, node: Limit, ctx: Context) -> Rel:
        rel = self.build(node.source, ctx)
        if not rel.context:
            return replace(rel, df=rel.df.limit(node.count))
        order = [F.lit(1)]
        if isinstance(node.source, OrderBy):
            order = [(self.expr(e, rel, ctx).asc() if up else self.expr(e, rel, ctx).desc()) for e, up in node.source.keys]
        rn = fresh("n")
        df = rel.df.withColumn(rn, F.row_number().over(Window.partitionBy(*rel.context).orderBy(*order))).where(F.col(rn) <= node.count).drop(rn)
        return replace(rel, df=df)

    def _empty(self, node: Empty, ctx: Context) -> Rel:
        return Rel(self.spark.range(0).select(), ())

    def _scalar(self, node: Scalar, ctx: Context) -> Rel:
        return self._select(Select(((node.expr, node.name),), One()), ctx)

    def _one(self, node: One, ctx: Context) -> Rel:
        return Rel(self.spark.range(1), ())

    def _range(self, node: Range, ctx: Context) -> Rel:
        one = Rel(self.spark.range(1), ())
        used = self.used(node, ctx)
        if isinstance(node.low, Literal) and isinstance(node.high, Literal) and node.low.kind == node.high.kind == "int":
            own = fresh("range")
            return Rel(self.spark.range(node.low.value, node.high.value + 1).select(F.col("id").alias(own)), (Col("range", None, own),))
        rel = self.lift(one, ctx, bool(used))
        low, high = self.expr(node.low, rel, ctx), self.expr(node.high, rel, ctx)
        own = fresh("range")
        if self.is_date(node.low, rel, ctx):
            low, high = low.cast("date"), high.cast("date")
            values = F.when(low <= high, F.sequence(low, high, F.expr("interval 1 day")))
        else:
            low, high = low.cast("bigint"), high.cast("bigint")
            values = F.when(low <= high, F.sequence(low, high))
        return Rel(rel.df.select(*rel.context, F.explode(values).alias(own)), (Col("range", None, own),), rel.context)

    def _depjoin(self, node: DepJoin, ctx: Context) -> Rel:
        return self.dependent(node.left, node.right, ctx, keep=False)

    def _listof(self, node: ListOf, ctx: Context) -> Rel:
        return self.dependent(node.keys, node.values, ctx, keep=False)

    def dependent(self, left: Any, right: Any, ctx: Context, keep: bool, key_test=None, lookup: tuple = ()) -> Rel:
        """The right side for each row of the left. keep: the left's columns are part of the result."""
        outer_used = self.used(DepJoin(left, right), ctx).union(*[self.used(e, ctx) for e in lookup])
        l = self.lift(self.build(left, ctx), ctx, bool(outer_used))
        if key_test is not None:
            l = key_test(l)
        inner = Context((Scope(l.cols, True), *ctx.scopes), l.df, tuple(dict.fromkeys([*l.context, *[c.own for c in l.cols]])))
        r = self.lift(self.build(right, inner), inner, True)
        cols = r.cols
        if keep:
            own = {c.name for c in r.cols}
            cols = tuple(c for c in l.cols if c.name not in own) + r.cols
        df = r.df.select(*dict.fromkeys([*l.context, *[c.own for c in cols]]))
        return Rel(df, cols, l.context, l.date | r.date)

    def _tupleof(self, node: TupleOf, ctx: Context) -> Rel:
        if node.kind == "zip":
            raise AlgebraError("zip tuples have no meaning")
        if not node.members:
            return self._empty(Empty(), ctx)
        if node.kind == "cross":
            if all(isinstance(m, Scalar) for m in node.members):
                return self._select(Select(tuple((m.expr, m.name) for m in node.members), One()), ctx)
            out = node.members[0]
            for m in node.members[1:]:
                out = Join(Literal(True, "bool"), out, m)
            return self.build(out, ctx)
        rels = [self.build(m, ctx) for m in node.members]
        need = any(r.context for r in rels)
        rels = [self.lift(r, ctx, need) for r in rels]
        first = rels[0]
        df = first.df.select(*first.context, *[c.own for c in first.cols])
        for r in rels[1:]:
            if len(r.cols) != len(first.cols):
                raise AlgebraError("members of a concat tuple have different columns")
            df = df.union(r.df.select(*r.context, *[c.own for c in r.cols]))
        return Rel(df, tuple(replace(c, relation=None) for c in first.cols), first.context, first.date)

    def _hashindex(self, node: HashIndex, ctx: Context) -> Rel:
        def keyed(l: Rel) -> Rel:
            if len(node.lookup) != len(l.cols):
                raise AlgebraError("as many lookups as keys are needed")
            return self._on_keys(l, [F.col(c.own) == self.expr(e, Rel(l.df, ()), ctx) for c, e in zip(l.cols, node.lookup)])

        return self.dependent(node.keys, node.values, ctx, keep=True, key_test=keyed, lookup=node.lookup)

    def _orderedindex(self, node: OrderedIndex, ctx: Context) -> Rel:
        def keyed(l: Rel) -> Rel:
            if len(node.bounds) != len(l.cols):
                raise AlgebraError("as many bounds as keys are needed")
            tests = []
            for c, (low, high) in zip(l.cols, node.bounds):
                k = F.col(c.own)
                if low:
                    v = self.expr(low.expr, Rel(l.df, ()), ctx)
                    tests.append(k >= v if low.closed else k > v)
                if high:
                    v = self.expr(high.expr, Rel(l.df, ()), ctx)
                    tests.append(k <= v if high.closed else k < v)
            return self._on_keys(l, tests)

        return self.dependent(node.keys, node.values, ctx, keep=True, key_test=keyed, lookup=tuple(b.expr for pair in node.bounds for b in pair if b))

    def _on_keys(self, l: Rel, tests: list[Column]) -> Rel:
        df = l.df
        for t in tests:
            df = df.where(t)
        return replace(l, df=df)

    def finish(self, rel: Rel) -> DataFrame:
        """The result with its names; midnight timestamps of date columns become dates."""
        return rel.df.select(*[(F.col(c.own).cast("date") if c.own in rel.date else F.col(c.own)).alias(c.name) for c in rel.cols])


def _walk(x: Any):
    yield x
    for c in children(x):
        yield from _walk(c)
