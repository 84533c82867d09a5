"""Golden results of the algebra on small tables, as bags."""

import datetime

import pytest
from fixture_tables import tables

from tessella.api import Engine
from tessella.plans.parser import parse
from tessella.plans.tree import AlgebraError


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, tables=tables(spark))


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def d(*texts):
    return [(datetime.date.fromisoformat(t),) for t in texts]


DATE_IDX = "select([k], aorderedidx(dedup(select([f as k], r_date)), ascalar(0 as z), {}))"
GOLDEN = [
    ("select([(1.0 + 2.0) as x, avg(a) as y, count() as z, sum(a) as r, min(a) as s, max(a) as t], alist(r2, ascalar(0.a)))", [(3.0, 7.978, 5, 39.89, -0.42, 34.42)]),
    ('select([(date("1997-07-01") + month(3)) as d, (date("1997-07-01") + day(90)) as dd], ascalar(0 as z))', [(datetime.date(1997, 10, 1), datetime.date(1997, 9, 29))]),
    ("depjoin(alist(r1, ascalar(0.f)), select([(0.f + g) as x], ascalar(5 as g)))", [(6,), (6,), (7,), (7,), (8,)]),
    ("AHashIdx(Dedup(Select([f], r1)), AList(Filter(f = 0.f, r1), ascalar(0.g)), 2)", [(2, 1), (2, 2)]),
    ("AOrderedIdx(OrderBy([f asc], Dedup(Select([f], r1))), AList(Filter(f = 0.f, r1), ascalar(0.g)), 1, 3)", [(1, 2), (1, 3), (2, 1), (2, 2)]),
    (DATE_IDX.format('>= date("2017-10-05"), < date("2018-09-01")'), d("2017-10-05", "2018-01-01", "2018-01-23")),
    (DATE_IDX.format('> date("2017-10-05"), <= date("2018-09-01")'), d("2018-01-01", "2018-01-23", "2018-09-01")),
    (DATE_IDX.format('> date("2017-10-05"), < date("2018-09-01")'), d("2018-01-01", "2018-01-23")),
    (DATE_IDX.format('>= date("2017-10-05"), <= date("2018-09-01")'), d("2017-10-05", "2018-01-01", "2018-01-23", "2018-09-01")),
    (DATE_IDX.format('date("2017-10-05"), date("2018-09-01")'), d("2017-10-05", "2018-01-01", "2018-01-23")),
    ('select([strlen("test") as l, strpos("testing", "in") as p], ascalar(0 as z))', [(4, 5)]),
    ("alist(orderby([f desc], r1), atuple([ascalar(0.f as f), ascalar(0.g as g)], cross))", [(1, 2), (1, 3), (2, 1), (2, 2), (3, 4)]),
    ("atuple([orderby([f desc], r1), atuple([ascalar(9 as f), ascalar(9 as g)], cross), r1], concat)", sorted([(1, 2), (1, 3), (2, 1), (2, 2), (3, 4)] * 2 + [(9, 9)])),
    ("select([sum(f) + 5 as p5, count() + sum(f / 2) as x], r1)".replace("sum(f) + 5", "(sum(f) + 5)").replace("count() + sum(f / 2)", "(count() + sum(f / 2))"), [(14, 9.5)]),
    # empty groups, duplicates and nested scopes
    ("depjoin(select([f as k], r), select([count() as n, sum(g) as s], filter(f < 0.k, r1)))", [(0, None), (0, None), (0, None), (2, 5), (2, 5), (4, 8), (5, 12)]),
    ("depjoin(select([f as k], r1), select([0.k, count() as n], filter(f > 0.k, r1)))", [(1, 3), (1, 3), (2, 1), (2, 1), (3, 0)]),
    ("depjoin(select([f as k], r1), join(a = b, select([g as a], filter(f = 0.k, r1)), select([g as b], filter(f >= 0.k, r1))))", sorted([(1, 1)] * 2 + [(2, 2)] * 6 + [(3, 3)] * 2 + [(4, 4)])),
    ("depjoin(select([f as k], r1), range(1, 0.k))", sorted([(1,)] * 5 + [(2,)] * 3 + [(3,)])),
    ("range(3, 1)", []),
    ("aempty", []),
    ("filter(not exists(filter(s.g = r.f, s)), r)", [(0, 5)]),
    ("select([f, (select([max(s.g) as m], filter(s.f < r.f, s))) as m], r)", [(0, None), (1, 5), (1, 5), (2, 5), (2, 5), (3, 5), (4, 5)]),
    ("filter(sum(g) > 4, groupby([f, count() as n], [f], r))", [(0, 1), (1, 2), (4, 1)]),
    ("select([str_field], filter(str_field = null, unique_str))", []),
    ("select([(7 / 2) as q, ((0 - 7) % 3) as m], ascalar(0 as z))", [(3.5, -1)]),
    ('select([substring("abcdef", 0, 3) as a, substring("abcdef", 2, 3) as b], ascalar(0 as z))', [("ab", "bcd")]),
    ('select([(date("2000-01-31") + month(1)) as m, (date("2000-03-01") - day(1)) as n], ascalar(0 as z))', [(datetime.date(2000, 2, 29), datetime.date(2000, 2, 29))]),
]


@pytest.mark.parametrize("text,want", GOLDEN)
def test_golden(engine, text, want):
    assert bag(engine.algebra(text)) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_two_key_ordered_index(engine):
    keys = "depjoin(ints, depjoin(select([x as y], ints), atuple([ascalar(1.x as x), ascalar(0.y as y)], cross)))"
    got = bag(engine.algebra(f"aorderedidx({keys}, atuple([ascalar(0.x as a), ascalar(0.y as b)], cross), >= 3, <= 5, >= 4, <= 6)"))
    assert got == [(x, y, x, y) for x in (3, 4, 5) for y in (4, 5, 6)]


LOG_QUERY = "alist(filter(succ > counter && id_p = id, {t}), alist(filter(0.counter < counter && counter < 0.succ && id = id_c, {t}), atuple([ascalar(1.counter as a), ascalar(0.counter as b)], cross)))"


def test_log_queries(engine):
    assert bag(engine.algebra(LOG_QUERY.format(t="log"), id_p=1, id_c=2)) == [(1, 2)]
    assert bag(engine.algebra(LOG_QUERY.format(t="log_str"), id_p="foo", id_c="fizzbuzz")) == [(1, 2)]


def test_prepared_query_runs_after_build(engine):
    p = engine.prepare("query lookup(k:int) { ahashidx(dedup(select([f], r1)), select([g], filter(f = 0.f, r1)), k) }").build()
    assert bag(p.run(k=2)) == [(2, 1), (2, 2)]
    assert bag(p.run(k=9)) == []
    with pytest.raises(AlgebraError):
        p.run()


def test_lateral_agrees_with_decorrelation(engine, spark):
    for name, df in tables(spark).items():
        df.createOrReplaceTempView(name)
    want = spark.sql("select t.g2 from (select f as k from r) l, lateral (select g + l.k as g2 from r1 where f <= l.k) t")
    assert bag(engine.algebra("depjoin(select([f as k], r), select([(g + 0.k) as g2], filter(f <= 0.k, r1)))")) == bag(want)
    want = spark.sql("select t.n from (select f as k from r) l, lateral (select count(*) as n from r1 where f = l.k) t")
    assert bag(engine.algebra("depjoin(select([f as k], r), select([count() as n], filter(f = 0.k, r1)))")) == bag(want)


def test_null_keys_meet(spark):
    e = Engine(spark, tables={"l": spark.createDataFrame([(1,), (None,), (None,)], "k long"), "t": spark.createDataFrame([(1, 2), (None, 3)], "f long, g long")})
    assert bag(e.algebra("depjoin(l, select([0.k as k, count() as n], filter(f = 0.k, t)))")) == [(1, 1), (None, 0), (None, 0)]


@pytest.mark.parametrize("text", ["select([f as a, g as a], r)", "join(true, r, r)", "filter(nothing = 1, r)", "filter(sum(f) > 1, r)", "select([2.f], r)", "filter(f = , r)", "unknown_relation", "atuple([r, s], zip)", "select([(select([f, g], r)) as x], r)"])
def test_errors(engine, text):
    with pytest.raises(AlgebraError):
        engine.algebra(text)


def test_scalar_subquery_with_many_rows_fails(engine):
    with pytest.raises(Exception, match="more than one row"):
        engine.algebra("select([f, (select([g], r)) as x], r1)").collect()


def test_grammar():
    assert parse("filter(a - 1 = 2 && b || c, r)") == parse("filter((((a - 1) = 2) && b) || c, r)  # comment")
    with pytest.raises(AlgebraError):
        parse("filter(a -1 = 2, r)")  # two operands
