"""Rewrites keep results; sources and sinks."""

import datetime

import pytest
from fixture_tables import tables

from tessella.api import Engine
from tessella.plans import rules
from tessella.plans.parser import parse
from tessella.plans.tree import AlgebraError, Binary, Join, Literal, Name, Query
from tessella.sources.catalog import Catalog, parameter, prefix_sample, sample, star_sample, text_rows, write_layout


def test_predicates_keep_their_meaning():
    p, q, yes, no = Name("p"), Name("q"), Literal(True, "bool"), Literal(False, "bool")
    assert rules.optimise(Binary("||", p, yes)) == yes
    assert rules.optimise(Binary("&&", p, no)) == no
    assert rules.optimise(Binary("&&", yes, Binary("||", no, q))) == q
    assert rules.optimise(Binary("||", p, Binary("&&", p, q))) != Binary("&&", p, q)


def test_cheap_tests_first():
    f = rules.optimise(parse('filter(strpos(a, "x") = 1 && b = 2, r)'))
    assert f.test.left == Binary("=", Name("b"), Literal(2, "int"))


def test_join_elimination(spark):
    text = "dedup(select([k, g], join(k = f, dedup(select([f as k], r)), r)))"
    new = rules.optimise(parse(text))
    assert not isinstance(new.source.source, Join)
    e = Engine(spark, tables=tables(spark))
    assert sorted(map(tuple, e.algebra(text).collect())) == sorted(map(tuple, tables(spark)["r"].distinct().collect()))


def test_fusion(spark):
    a, b = Query("a", (), parse("select([f], r)")), Query("b", (), parse("select([g], s)"))
    q = rules.fuse([a, b], [[("f", "int")], [("g", "int")]])
    e = Engine(spark, tables=tables(spark))
    assert sorted(r["f"] for r in e.tree(q.body, query_id=0).collect()) == sorted(r["f"] for r in tables(spark)["r"].collect())
    assert sorted(r["g"] for r in e.tree(q.body, query_id=1).collect()) == sorted(r["g"] for r in tables(spark)["s"].collect())
    with pytest.raises(AlgebraError):
        rules.fuse([a, b], [[("f", "int")], [("f", "string")]])


def test_subsumption():
    view = parse("select([a, b as c], filter(a > 1, r))")
    assert rules.subsumes(view, parse("select([a], filter(a > 1 && b = 2, r))")) is not None
    assert rules.subsumes(view, parse("select([a], filter(b = 2, r))")) is None
    assert rules.subsumes(view, parse("select([d], filter(a > 1, r))")) is None


def test_ddl_and_parameters(spark):
    c = Catalog()
    schema = c.create(spark, "create table t (a int primary key, b varchar(10) not null, c decimal(7,2), d date, foreign key (b) references u (x));")
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("a", "bigint", False), ("b", "string", False), ("c", "double", True), ("d", "date", True)]
    assert c.keys["t"] == {"primary": ["a"], "foreign": {"b": ("u", "x")}}
    assert parameter("1997-07-01", "date") == datetime.date(1997, 7, 1) and parameter("t", "bool") is True and parameter("1.5", "fixed") == 1.5
    with pytest.raises(AlgebraError):
        parameter("x", "blob")


def test_sinks_and_samples(spark, tmp_path):
    r = tables(spark)["r"]
    assert sorted(x["line"] for x in text_rows(tables(spark)["r2"]).collect())[0] == "-0.420000"
    write_layout(r, str(tmp_path / "x"), ["f"], ordered=True)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 7
    assert sample(r, 3).count() == 3 and prefix_sample(r, 2).count() == 2
    got = star_sample({"r": r, "s": tables(spark)["s"]}, "r", 2, 1, [("r", "f", "s", "f")])
    assert got["s"].select("f").distinct().count() <= 2


def test_probe_time_and_timeout(spark):
    e = Engine(spark, tables=tables(spark))
    df = e.algebra("r")
    assert e.explain(df)["bytes"] > 0 and e.timed(df, 0.1)["qps"] > 0
    assert len(e.within(df, 30)) == 7


def test_filters_reach_the_scan(spark):
    df = Engine(spark, "/root/testdata/sf0.001", dates=frozenset({"l_shipdate"})).algebra('select([l_orderkey], filter(l_shipdate <= date("1996-01-01"), lineitem))')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp" in plan
