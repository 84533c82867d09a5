"""Every query with SQL agrees with DuckDB."""

import oracle
import pytest

from tessella.operators import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    if name in catalogue.ORACLE:
        assert oracle.compare(df, con, catalogue.ORACLE[name]) == ""
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["orderby_r28", "limit_topk_r29", "limit_offset_g5"])
def test_order(spark, con, name):
    got = [tuple(map(oracle.plain, r)) for r in catalogue.QUERIES[name](spark, FOLDER).collect()]
    assert got == [tuple(map(oracle.plain, r)) for r in con.execute(catalogue.ORACLE[name]).fetchall()]


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_subqueries_scan_their_relations_once(spark, k):
    from tessella.api import Engine

    exists = " && ".join(f"exists(filter(o_custkey = c_custkey && o_totalprice > {i}.0, orders))" for i in range(k))
    scalar = " && ".join(f"c_acctbal > (select([min(p) as m], filter(k = c_custkey && p > {i}.0, select([o_custkey as k, o_totalprice as p], orders))))" for i in range(k))
    for test in (exists, scalar):
        assert scans(Engine(spark, FOLDER).algebra(f"select([c_custkey], filter({test}, customer))")) == 1 + k


@pytest.mark.parametrize("advisory", ["64m", "2k"])
def test_row_numbers_with_many_partitions(spark, con, advisory):
    from tessella.api import Engine

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        got = Engine(spark, FOLDER).algebra("select([l_orderkey, l_linenumber, l_partkey, row_number() as rn], orderby([l_orderkey, l_linenumber], lineitem))").collect()
        n = con.execute("select count(*) from lineitem").fetchone()[0]
        assert sorted(r["rn"] for r in got) == list(range(1, n + 1))
        own = sorted(got, key=lambda r: r["rn"])
        assert all((a["l_orderkey"], a["l_linenumber"]) <= (b["l_orderkey"], b["l_linenumber"]) for a, b in zip(own, own[1:]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_results_are_read_back(spark, tmp_path):
    from tessella.api import Engine
    from tessella.sources.catalog import read_result, text_rows, write_result

    df = Engine(spark, FOLDER).algebra("select([n_nationkey, n_name, (n_nationkey > 3) as far], nation)")
    write_result(df, f"{tmp_path}/r")
    assert read_result(spark, f"{tmp_path}/r").schema == df.schema and sorted(read_result(spark, f"{tmp_path}/r").collect()) == sorted(df.collect())
    assert text_rows(spark.sql("select cast(null as boolean) as b, 1.5d as d")).first()["line"] == "null|1.500000"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
