"""The registered queries: one for each operator, as algebra text (or a function) with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.api import Engine
from tessella.plans.parser import parse
from tessella.plans.rules import fuse, subsumes
from tessella.sources.catalog import star_sample, text_rows

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


#: Midnight timestamps of the test tables that are dates.
DATES = frozenset({"l_shipdate", "o_orderdate"})


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, sf_dir, dates=DATES)


def _add(name: str, query: str | Run, sql: str | None = None, **params) -> None:
    if isinstance(query, str):
        text = query

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _engine(spark, sf_dir).algebra(text, **params)

        QUERIES[name] = run
    else:
        QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _sql(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """A query of the SQL front-end; the oracle is the same text where dialects agree."""
    _add(name, lambda spark, sf_dir: _engine(spark, sf_dir).sql(text, tables.split()), oracle or text)


# scans and sources
_add("scan_r1", "region", "select * from region")
_add("range_r3", "range(3, 40)", "select range::bigint as range from range(3, 41) t(range)")
_add("range_date_r4", 'range(date("1996-02-25"), date("1996-03-05"))', "select d::date as range from generate_series(timestamp '1996-02-25', timestamp '1996-03-05', interval 1 day) t(d)")
_add("empty_r5", "depjoin(aempty, select([r_regionkey, r_name], region))", "select r_regionkey, r_name from region where false")
_add("scalar_r6", "ascalar((2 + 3) as v)", "select 5::bigint as v")


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    t = {n: e.catalog.table(spark, n)[0] for n in ("lineitem", "orders", "customer")}
    got = star_sample(t, "lineitem", 500, 7, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")], ["l_orderkey", "l_linenumber", "l_partkey"])
    return got["customer"].select("c_custkey", "c_nationkey")


_add(
    "sample_referential_r18",
    _sample,
    "select c_custkey, c_nationkey from customer where c_custkey in (select o_custkey from orders where o_orderkey in (select l_orderkey from"
    " (select l_orderkey from lineitem order by md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_orderkey, l_linenumber, l_partkey limit 500)))",
)
_add("sink_text_r13", lambda spark, sf_dir: text_rows(_engine(spark, sf_dir).algebra("select([s_suppkey, s_name, s_acctbal, (s_nationkey > 10) as far], supplier)")), "select s_suppkey || '|' || s_name || '|' || printf('%.6f', s_acctbal) || '|' || case when s_nationkey > 10 then 't' else 'f' end as line from supplier")

# relational core
_add("project_r20", "select([o_orderkey, (o_totalprice * 2) as twice], orders)", "select o_orderkey, o_totalprice * 2 as twice from orders")
_add("global_agg_r21", "select([count() as n, sum(l_linenumber) as s, max(l_quantity) as m], lineitem)", "select count(*) as n, sum(l_linenumber)::bigint as s, max(l_quantity) as m from lineitem")
_add("global_agg_empty_r21", "select([count() as n, max(l_quantity) as m], filter(l_quantity < 0, lineitem))", "select count(*) as n, max(l_quantity) as m from lineitem where l_quantity < 0")
_add("mixed_agg_r22", "select([l_linestatus, count() as n], lineitem)", "select min(l_linestatus) as l_linestatus, count(*) as n from lineitem")
_add("filter_r23", 'filter(l_shipdate <= date("1995-06-30") && l_quantity > 40, select([l_orderkey, l_linenumber, l_shipdate, l_quantity], lineitem))', "select l_orderkey, l_linenumber, l_shipdate::date as l_shipdate, l_quantity from lineitem where l_shipdate <= date '1995-06-30' and l_quantity > 40")
_add("having_r24", "filter(n > 15, groupby([o_custkey, count() as n], [o_custkey], orders))", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 15")
_add("having_agg_r24", "filter(sum(o_totalprice) > 1000000.0, groupby([o_custkey, count() as n], [o_custkey], orders))", "select o_custkey, count(*) as n from orders group by 1 having sum(o_totalprice) > 1000000")
_add("groupby_r25", "groupby([l_returnflag, l_linestatus, count() as n, max(l_quantity) as q], [l_returnflag, l_linestatus], lineitem)", "select l_returnflag, l_linestatus, count(*) as n, max(l_quantity) as q from lineitem group by 1, 2")
_add("groupby_nokey_r26", "groupby([count() as n, min(p_size) as s], [], part)", "select count(*) as n, min(p_size) as s from part")
_add("dedup_r27", "dedup(select([p_brand, p_size], part))", "select distinct p_brand, p_size from part")
_add("orderby_r28", "orderby([o_totalprice desc, o_orderkey], select([o_orderkey, o_totalprice], orders))", "select o_orderkey, o_totalprice from orders order by 2 desc, 1")
_add("limit_topk_r29", "limit(20, orderby([o_totalprice desc, o_orderkey], select([o_orderkey, o_totalprice], orders)))", "select o_orderkey, o_totalprice from orders order by 2 desc, 1 limit 20")
_add(
    "rownum_w1",
    "select([l_orderkey, l_linenumber, row_number() as rn], orderby([l_orderkey, l_linenumber], dedup(select([l_orderkey, l_linenumber], lineitem))))",
    "select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber) as rn from (select distinct l_orderkey, l_linenumber from lineitem)",
)

# layouts
_add("list_l1", "alist(nation, atuple([ascalar(0.n_nationkey as k), ascalar((0.n_regionkey * 10) as r)], cross))", "select n_nationkey as k, (n_regionkey * 10)::bigint as r from nation")
_add("tuple_cross_l2", "atuple([select([r_name], region), select([n_name], nation)], cross)", "select r_name, n_name from region, nation")
_add("tuple_concat_l3", "atuple([select([n_name as name], nation), select([r_name as name], region)], concat)", "select n_name as name from nation union all select r_name from region")
_add("hash_idx_l6", "ahashidx(dedup(select([o_custkey as k], orders)), select([o_orderkey, o_totalprice], filter(o_custkey = 0.k, orders)), 7)", "select o_custkey as k, o_orderkey, o_totalprice from orders where o_custkey = 7")
_add("hash_idx_multi_l7", 'ahashidx(dedup(select([l_returnflag as rf, l_linenumber as ln], lineitem)), select([count() as n, max(l_quantity) as q], filter(l_returnflag = 0.rf && l_linenumber = 0.ln, lineitem)), ("R", 3))', "select l_returnflag as rf, l_linenumber as ln, count(*) as n, max(l_quantity) as q from lineitem where l_returnflag = 'R' and l_linenumber = 3 group by 1, 2")
_add("ordered_idx_l9", 'aorderedidx(dedup(select([o_orderdate as d], orders)), select([o_orderkey], filter(o_orderdate = 0.d, orders)), >= date("1996-01-01"), < date("1996-02-01"))', "select o_orderdate::date as d, o_orderkey from orders where o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-02-01'")
_add("ordered_idx_bounds_l10", "aorderedidx(dedup(select([p_size as s], part)), select([count() as n], filter(p_size = 0.s, part)), > 3, <= 9)", "select p_size as s, count(*) as n from part where p_size > 3 and p_size <= 9 group by 1")
_add("ordered_idx_multidim_l11", "aorderedidx(dedup(select([l_linenumber as a, l_suppkey as b], lineitem)), select([count() as n], filter(l_linenumber = 0.a && l_suppkey = 0.b, lineitem)), >= 2, <= 3, >= 5, < 9)", "select l_linenumber as a, l_suppkey as b, count(*) as n from lineitem where l_linenumber between 2 and 3 and l_suppkey >= 5 and l_suppkey < 9 group by 1, 2")
_add("row_store_l12", "alist(supplier, atuple([ascalar(0.s_suppkey as s_suppkey), ascalar(0.s_acctbal as s_acctbal)], cross))", "select s_suppkey, s_acctbal from supplier")

# joins
_add("join_theta_j1", "select([n_name, r_name], join(n_regionkey + 1 = r_regionkey && n_nationkey > r_regionkey, nation, region))", "select n_name, r_name from nation, region where n_regionkey + 1 = r_regionkey and n_nationkey > r_regionkey")
_add("join_equi_j2", "select([o_orderkey, c_name], join(o_custkey = c_custkey, orders, customer))", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
_add("join_cross_j3", "select([n_name, r_name], join(true, nation, region))", "select n_name, r_name from nation, region")
_add("depjoin_j4", "depjoin(select([c_custkey as k, c_acctbal as b], customer), select([0.k as k, (0.b + o_totalprice) as v], filter(o_custkey = 0.k, orders)))", "select c_custkey as k, c_acctbal + o_totalprice as v from customer, orders where o_custkey = c_custkey")
_add("depjoin_agg_j4", "depjoin(select([c_custkey as k], customer), select([0.k as k, count() as n, max(o_totalprice) as m], filter(o_custkey = 0.k, orders)))", "select c_custkey as k, count(o_orderkey) as n, max(o_totalprice) as m from customer left join orders on o_custkey = c_custkey group by 1")
_add("depjoin_nested_j4", "depjoin(select([n_nationkey as n], nation), depjoin(select([s_suppkey as s, s_acctbal as b], filter(s_nationkey = 0.n, supplier)), select([1.n as n, 0.s as s, count() as richer], filter(c_nationkey = 1.n && c_acctbal > 0.b, customer))))", "select n_nationkey as n, s_suppkey as s, count(c_custkey) as richer from nation join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey and c_acctbal > s_acctbal group by 1, 2")
_add("depjoin_range_j4", "depjoin(select([n_nationkey as k, n_regionkey as r], nation), select([0.k as k, range as i], range(0.r, 3)))", "select n_nationkey::int as k, i::bigint as i from nation, range(0, 4) t(i) where i >= n_regionkey")
_add("join_range_j5", "select([s_suppkey, n_nationkey], join(s_acctbal > n_nationkey * 300 && s_acctbal < n_nationkey * 300 + 500, supplier, nation))", "select s_suppkey, n_nationkey from supplier, nation where s_acctbal > n_nationkey * 300 and s_acctbal < n_nationkey * 300 + 500")
_add("semi_j9", "select([c_custkey], filter(exists(filter(o_custkey = c_custkey && o_totalprice > 300000.0, orders)), customer))", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
_add("anti_j10", "select([c_custkey], filter(not exists(filter(o_custkey = c_custkey, orders)), customer))", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
_add("self_join_j11", "select([a, b], join(ra = rb && a < b, select([n_nationkey as a, n_regionkey as ra], nation), select([n_nationkey as b, n_regionkey as rb], nation)))", "select x.n_nationkey as a, y.n_nationkey as b from nation x, nation y where x.n_regionkey = y.n_regionkey and x.n_nationkey < y.n_nationkey")
_NULLS = "select([if o_custkey % 5 = 0 then null:int else o_custkey as ck, o_orderstatus], orders)"
_add(
    "join_elim_j12",
    f"dedup(select([k, o_orderstatus], join(k = ck, dedup(select([ck as k], {_NULLS})), {_NULLS})))",
    "select distinct o_custkey as k, o_orderstatus from orders where o_custkey % 5 <> 0",
)

# aggregates
_add("agg_count_a1", "select([count() as n], orders)", "select count(*) as n from orders")
_add("agg_sum_a2", "groupby([l_suppkey, sum(l_linenumber) as s], [l_suppkey], lineitem)", "select l_suppkey, sum(l_linenumber)::bigint as s from lineitem group by 1")
_add("agg_avg_a3", "groupby([l_linenumber, avg(l_linenumber + l_orderkey) as a], [l_linenumber], lineitem)", "select l_linenumber, avg(l_linenumber + l_orderkey) as a from lineitem group by 1")
_add("agg_min_a4", "groupby([l_shipdate, min(l_extendedprice) as m], [l_shipdate], lineitem)", "select l_shipdate::date as l_shipdate, min(l_extendedprice) as m from lineitem group by 1")
_add("agg_max_a5", "groupby([p_brand, max(p_retailprice) as m], [p_brand], part)", "select p_brand, max(p_retailprice) as m from part group by 1")
_add("agg_expr_a6", "groupby([l_suppkey, (sum(l_linenumber) + 5) as p5, (count() + sum(l_linenumber / 2)) as x], [l_suppkey], lineitem)", "select l_suppkey, (sum(l_linenumber) + 5)::bigint as p5, count(*) + sum(l_linenumber / 2) as x from lineitem group by 1")

# sets
_add("union_all_u1", "atuple([select([l_suppkey as k], filter(l_quantity > 49, lineitem)), select([s_suppkey as k], supplier)], concat)", "select l_suppkey as k from lineitem where l_quantity > 49 union all select s_suppkey from supplier")
_add("union_u2", "dedup(atuple([select([l_suppkey as k], filter(l_quantity > 49, lineitem)), select([s_suppkey as k], supplier)], concat))", "select l_suppkey as k from lineitem where l_quantity > 49 union select s_suppkey from supplier")
_sql("intersect_u3", "select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier", "customer supplier")
_sql("except_u3", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000", "nation supplier")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = parse("query a(low:fixed) { select([p_partkey as k, p_name as name], filter(p_retailprice > low, part)) }")
    b = parse("query b(low:fixed) { select([s_suppkey as k, s_acctbal as bal], filter(s_acctbal > low, supplier)) }")
    q = fuse([a, b], [[("k", "int"), ("name", "string")], [("k", "int"), ("bal", "fixed")]])
    return _engine(spark, sf_dir).tree(q.body, query_id=1, low=5000.0)


_add("fusion_u4", _fused, "select s_suppkey as k, '' as name, s_acctbal as bal from supplier where s_acctbal > 5000")

# scalar operators and functions
_add("cmp_f1_f5", "select([p_partkey, (p_size = 5) as eq, (p_size < 5) as lt, (p_size <= 5) as le, (p_size > 5) as gt, (p_size >= 5) as ge], part)", "select p_partkey, p_size = 5 as eq, p_size < 5 as lt, p_size <= 5 as le, p_size > 5 as gt, p_size >= 5 as ge from part")
_add("bool_f6_f8", 'select([p_partkey], filter(not (p_size > 10 && p_brand = "Brand#1") || p_size = 11, part))', "select p_partkey from part where not (p_size > 10 and p_brand = 'Brand#1') or p_size = 11")
_add("arith_f9_f13", "select([p_partkey, (p_size + 3) as a, (p_size - 7) as s, (p_size * 2) as m, (p_size / 4) as d, ((p_size - 20) % 7) as r], part)", "select p_partkey, (p_size + 3)::bigint as a, (p_size - 7)::bigint as s, (p_size * 2)::bigint as m, p_size / 4 as d, ((p_size - 20) % 7)::bigint as r from part")
_add("strpos_f14", 'select([p_partkey, strpos(p_type, "E") as at], part)', "select p_partkey, strpos(p_type, 'E')::bigint as at from part")
_add("strlen_f15", "select([p_partkey, strlen(p_name) as n], part)", "select p_partkey, length(p_name)::bigint as n from part")
_add("substring_f16", "select([p_partkey, substring(p_name, 2, 4) as a, substring(p_name, 0, 3) as b], part)", "select p_partkey, substring(p_name, 2, 4) as a, substring(p_name, 0, 3) as b from part")
for _unit, _id, _n in (("year", "f17", 2), ("month", "f18", 5), ("day", "f19", 45)):
    _add(f"add_{_unit}_{_id}", f"select([o_orderkey, (o_orderdate + {_unit}({_n})) as later, (o_orderdate - {_unit}({_n})) as sooner], orders)", f"select o_orderkey, (o_orderdate + interval {_n} {_unit})::date as later, (o_orderdate - interval {_n} {_unit})::date as sooner from orders")
for _op, _id, _name in (("to_year", "f20", "year"), ("to_mon", "f21", "month"), ("to_day", "f22", "day")):
    _add(f"{_op}_{_id}", f"groupby([k, count() as n], [k], select([{_op}(o_orderdate) as k], orders))", f"select {_name}(o_orderdate)::bigint as k, count(*) as n from orders group by 1")
_add("if_f23", 'select([o_orderkey, if o_totalprice > 200000.0 then "high" else "low" as band], orders)', "select o_orderkey, case when o_totalprice > 200000 then 'high' else 'low' end as band from orders")
_add("suffix_f26", 'select([p_partkey], filter(strpos(p_type, "COPPER") = strlen(p_type) - strlen("COPPER") + 1, part))', "select p_partkey from part where strpos(p_type, 'COPPER') = length(p_type) - 5")

# subqueries, parameters, rewrites
_add("scalar_subq_q1", "select([s_suppkey, s_acctbal], filter(s_acctbal = (select([max(b) as m], select([s_acctbal as b], supplier))), supplier))", "select s_suppkey, s_acctbal from supplier where s_acctbal = (select max(s_acctbal) from supplier)")
_add("exists_q2", "select([n_name, if exists(filter(s_nationkey = n_nationkey && s_acctbal > 9000.0, supplier)) then 1 else 0 as rich], nation)", "select n_name, case when exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 9000) then 1 else 0 end::bigint as rich from nation")
_add(
    "corr_agg_q4",
    "select([p_partkey], filter(p_retailprice > (select([avg(price) as a], filter(brand = p_brand, select([p_brand as brand, p_retailprice as price], part)))), part))",
    "select p_partkey from part p where p_retailprice > (select avg(p_retailprice) from part q where q.p_brand = p.p_brand)",
)
_add(  # the subquery's own p_retailprice hides the outer one
    "corr_hidden_q3",
    "select([p_partkey], filter(p_retailprice > (select([(1.1 * avg(p_retailprice)) as a], filter(b = p_brand, select([p_brand as b, p_retailprice], part)))), part))",
    "select p_partkey from part p where p_retailprice > (select 1.1 * avg(q.p_retailprice) from part q where q.p_brand = p.p_brand)",
)
_add(
    "corr_count_q4",
    "select([c_custkey], filter((select([count() as n], filter(k = c_custkey, select([o_custkey as k], orders)))) < 8, customer))",
    "select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) < 8",
)
_add("params_e8", "select([o_orderkey, o_totalprice], filter(o_orderdate >= lo && o_totalprice > least, orders))", "select o_orderkey, o_totalprice from orders where o_orderdate >= date '1997-01-01' and o_totalprice > 250000.5", lo=__import__("datetime").date(1997, 1, 1), least=250000.5)


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    e.catalog.add("big", e.algebra("groupby([l_orderkey as k, count() as n], [l_orderkey], lineitem)"))
    return e.algebra("select([k, n], join(n = m, big, select([max(n) as m], big)))")


_add("cse_o12", _shared, "with big as (select l_orderkey as k, count(*) as n from lineitem group by 1) select k, n from big where n = (select max(n) from big)")


def _from_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    view = parse("select([p_partkey, p_brand as brand, p_size], filter(p_size > 10, part))")
    e.catalog.add("view", e.tree(view))
    return e.tree(subsumes(view, parse('select([p_partkey, p_size], filter(p_size > 10 && p_brand = "Brand#3", part))')))


_add("subsume_o15", _from_view, "select p_partkey, p_size from part where p_size > 10 and p_brand = 'Brand#3'")

# TPC-H, with the columns that the tables have; sums are rounded to cents
_R = "round({}, 2)"
QUERIES["tpch_q1"] = lambda spark, sf_dir: _engine(spark, sf_dir).algebra('orderby([l_returnflag, l_linestatus], groupby([l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base, sum(l_extendedprice * (1 - l_discount)) as sum_disc, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as sum_charge, avg(l_quantity) as avg_qty, avg(l_discount) as avg_disc, count() as n], [l_returnflag, l_linestatus], filter(l_shipdate <= date("1998-12-01") - day(90), lineitem)))').withColumns({c: F.round(c, 2) for c in ("sum_qty", "sum_base", "sum_disc", "sum_charge")} | {c: F.round(c, 4) for c in ("avg_qty", "avg_disc")})
ORACLE["tpch_q1"] = "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 4) as avg_disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2"


def _money(name: str, text: str, sql: str, *columns: str, **params) -> None:
    """A query whose sums are rounded to cents on both sides."""
    _add(name, lambda spark, sf_dir: _engine(spark, sf_dir).algebra(text, **params).withColumns({c: F.round(c, 2) for c in columns}), sql)


_REV = "l_extendedprice * (1 - l_discount)"
_money("tpch_q3", f'limit(10, orderby([revenue desc, l_orderkey], groupby([l_orderkey, o_orderdate, sum({_REV}) as revenue], [l_orderkey, o_orderdate], join(l_orderkey = o_orderkey, filter(l_shipdate > date("1996-03-15"), lineitem), join(o_custkey = c_custkey, filter(o_orderdate < date("1996-03-15"), orders), filter(c_mktsegment = "BUILDING", customer))))))', f"select l_orderkey, o_orderdate::date as o_orderdate, round(sum({_REV}), 2) as revenue from lineitem, orders, customer where l_orderkey = o_orderkey and o_custkey = c_custkey and l_shipdate > date '1996-03-15' and o_orderdate < date '1996-03-15' and c_mktsegment = 'BUILDING' group by 1, 2 order by 3 desc, 1 limit 10", "revenue")
_money("tpch_q5", f'groupby([n_name, sum({_REV}) as revenue], [n_name], join(l_suppkey = s_suppkey && c_nationkey = s_nationkey, join(l_orderkey = o_orderkey, lineitem, join(o_custkey = c_custkey, filter(o_orderdate >= date("1996-01-01") && o_orderdate < date("1997-01-01"), orders), customer)), join(s_nationkey = n_nationkey, supplier, join(n_regionkey = r_regionkey, nation, filter(r_name = "ASIA", region)))))', f"select n_name, round(sum({_REV}), 2) as revenue from lineitem, orders, customer, supplier, nation, region where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01' group by 1", "revenue")
_money("tpch_q6", 'select([sum(l_extendedprice * l_discount) as revenue], filter(l_shipdate >= date("1996-01-01") && l_shipdate < date("1996-01-01") + year(1) && l_discount >= 0.05 && l_discount <= 0.07 && l_quantity < 24, lineitem))', "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24", "revenue")
_money("tpch_q7", f"groupby([supp, cust, y, sum(v) as volume], [supp, cust, y], select([supp, cust, to_year(l_shipdate) as y, ({_REV}) as v], join(l_suppkey = s_suppkey && ((supp = a && cust = b) || (supp = b && cust = a)), join(l_orderkey = o_orderkey, lineitem, join(o_custkey = c_custkey, orders, join(c_nationkey = cn, customer, select([n_nationkey as cn, n_name as cust], nation)))), join(s_nationkey = sn, supplier, select([n_nationkey as sn, n_name as supp], nation)))))", f"select n1.n_name as supp, n2.n_name as cust, year(l_shipdate)::bigint as y, round(sum({_REV}), 2) as volume from lineitem, orders, customer, supplier, nation n1, nation n2 where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and ((n1.n_name = 'FRANCE' and n2.n_name = 'GERMANY') or (n1.n_name = 'GERMANY' and n2.n_name = 'FRANCE')) group by 1, 2, 3", "volume", a="FRANCE", b="GERMANY")
_money("tpch_q8", f'groupby([y, (sum(if supp = "BRAZIL" then v else 0.0) / sum(v)) as share], [y], select([to_year(o_orderdate) as y, ({_REV}) as v, supp], join(l_suppkey = s_suppkey, join(l_partkey = p_partkey, join(l_orderkey = o_orderkey, lineitem, join(o_custkey = c_custkey, orders, join(c_nationkey = cn, customer, join(cr = r_regionkey, select([n_nationkey as cn, n_regionkey as cr], nation), filter(r_name = "AMERICA", region))))), part), join(s_nationkey = sn, supplier, select([n_nationkey as sn, n_name as supp], nation)))))', f"select year(o_orderdate)::bigint as y, round(sum(case when n2.n_name = 'BRAZIL' then {_REV} else 0 end) / sum({_REV}), 2) as share from lineitem, orders, customer, supplier, part, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey group by 1", "share")
_money("tpch_q10", f'limit(20, orderby([revenue desc, c_custkey], groupby([c_custkey, c_name, n_name, sum({_REV}) as revenue], [c_custkey, c_name, n_name], join(l_orderkey = o_orderkey, filter(l_returnflag = "R", lineitem), join(o_custkey = c_custkey, filter(o_orderdate >= date("1996-10-01") && o_orderdate < date("1996-10-01") + month(3), orders), join(c_nationkey = n_nationkey, customer, nation))))))', f"select c_custkey, c_name, n_name, round(sum({_REV}), 2) as revenue from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and l_returnflag = 'R' and o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' group by 1, 2, 3 order by 4 desc, 1 limit 20", "revenue")
_money("tpch_q14", f'select([(100.0 * sum(if strpos(p_type, "PROMO") = 1 then {_REV} else 0.0) / sum({_REV})) as promo], join(l_partkey = p_partkey, filter(l_shipdate >= date("1996-09-01") && l_shipdate < date("1996-09-01") + month(1), lineitem), part))', f"select round(100.0 * sum(case when p_type like 'PROMO%' then {_REV} else 0 end) / sum({_REV}), 2) as promo from lineitem, part where l_partkey = p_partkey and l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-10-01'", "promo")
_money("tpch_q15", f'select([s_suppkey, s_name, total], filter(total = (select([max(t) as m], groupby([k2, sum(v2) as t], [k2], select([l_suppkey as k2, ({_REV}) as v2], filter(l_shipdate >= date("1996-01-01") && l_shipdate < date("1996-01-01") + month(3), lineitem))))), join(s_suppkey = k, supplier, groupby([k, sum(v) as total], [k], select([l_suppkey as k, ({_REV}) as v], filter(l_shipdate >= date("1996-01-01") && l_shipdate < date("1996-01-01") + month(3), lineitem))))))'.replace("sum(v2) as t]", "(sum(v2 * 100) - sum(v2 * 100) % 1) as t]").replace("sum(v) as total]", "(sum(v * 100) - sum(v * 100) % 1) as total]"), f"with r as (select l_suppkey as k, sum({_REV} * 100) - sum({_REV} * 100) % 1 as total from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by 1) select s_suppkey, s_name, round(total, 2) as total from supplier, r where s_suppkey = k and total = (select max(total) from r)", "total")
_money("tpch_q17", 'select([(sum(l_extendedprice) / 7.0) as yearly], filter(l_quantity < (select([(0.2 * avg(q)) as a], filter(k = p_partkey, select([l_partkey as k, l_quantity as q], lineitem)))), join(l_partkey = p_partkey, lineitem, filter(p_brand = "Brand#8", part))))', "select round(sum(l_extendedprice) / 7.0, 2) as yearly from lineitem l, part where p_partkey = l_partkey and p_brand = 'Brand#8' and l_quantity < (select 0.2 * avg(l_quantity) from lineitem i where i.l_partkey = p_partkey)", "yearly")
_money("tpch_q18", "limit(100, orderby([o_totalprice desc, o_orderkey], select([c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, q], join(o_custkey = c_custkey, join(o_orderkey = k, orders, filter(q > 200, groupby([k, sum(v) as q], [k], select([l_orderkey as k, l_quantity as v], lineitem)))), customer))))", "select c_name, c_custkey, o_orderkey, o_orderdate::date as o_orderdate, o_totalprice, round(sum(l_quantity), 2) as q from customer, orders, lineitem where c_custkey = o_custkey and o_orderkey = l_orderkey group by 1, 2, 3, 4, 5 having sum(l_quantity) > 200 order by o_totalprice desc, o_orderkey limit 100", "q")
_money("tpch_q19", f'select([sum({_REV}) as revenue], filter((p_brand = "Brand#1" && l_quantity >= 1 && l_quantity <= 11 && p_size <= 5) || (p_brand = "Brand#2" && l_quantity >= 10 && l_quantity <= 20 && p_size <= 10) || (p_brand = "Brand#3" && l_quantity >= 20 && l_quantity <= 30 && p_size <= 15), join(l_partkey = p_partkey, lineitem, part)))', f"select round(sum({_REV}), 2) as revenue from lineitem, part where l_partkey = p_partkey and ((p_brand = 'Brand#1' and l_quantity between 1 and 11 and p_size <= 5) or (p_brand = 'Brand#2' and l_quantity between 10 and 20 and p_size <= 10) or (p_brand = 'Brand#3' and l_quantity between 20 and 30 and p_size <= 15))", "revenue")
_add(  # lineitem stands for the offers of suppliers
    "tpch_q2",
    "select([p_partkey, s_name, l_extendedprice], filter(l_extendedprice = (select([min(e) as m], filter(k = p_partkey,"
    " select([l_partkey as k, l_extendedprice as e], lineitem)))), join(l_suppkey = s_suppkey, join(l_partkey = p_partkey, lineitem, filter(p_size = 15, part)), supplier)))",
    "select p_partkey, s_name, l_extendedprice from lineitem, part, supplier where l_partkey = p_partkey and l_suppkey = s_suppkey and p_size = 15"
    " and l_extendedprice = (select min(l_extendedprice) from lineitem where l_partkey = p_partkey)",
)
_add(
    "tpch_q4",
    'groupby([o_orderpriority, count() as n], [o_orderpriority], filter(o_orderdate >= date("1996-07-01") && o_orderdate < date("1996-07-01") + month(3)'
    " && exists(filter(l_orderkey = o_orderkey && l_shipdate > o_orderdate + day(60), lineitem)), orders))",
    "select o_orderpriority, count(*) as n from orders where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01'"
    " and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 60 day) group by 1",
)
_add(
    "tpch_q20",
    "select([s_name], filter(exists(filter(l_suppkey = s_suppkey && l_quantity > (select([(1.6 * avg(q)) as a], filter(k = l_partkey,"
    " select([l_partkey as k, l_quantity as q], lineitem)))), lineitem)), supplier))",
    "select s_name from supplier where exists (select 1 from lineitem l where l_suppkey = s_suppkey"
    " and l_quantity > (select 1.6 * avg(l_quantity) from lineitem i where i.l_partkey = l.l_partkey))",
)
_OTHER = "select([l_orderkey as k, l_suppkey as s, l_shipdate as d], lineitem)"
_add(
    "tpch_q21",
    f"groupby([s_name, count() as n], [s_name], filter(exists(filter(k = l_orderkey && not(s = l_suppkey), {_OTHER}))"
    f" && not(exists(filter(k = l_orderkey && not(s = l_suppkey) && d > l_shipdate, {_OTHER}))), join(s_suppkey = l_suppkey, supplier, lineitem)))",
    "select s_name, count(*) as n from supplier, lineitem l where s_suppkey = l_suppkey"
    " and exists (select 1 from lineitem o where o.l_orderkey = l.l_orderkey and o.l_suppkey <> l.l_suppkey)"
    " and not exists (select 1 from lineitem o where o.l_orderkey = l.l_orderkey and o.l_suppkey <> l.l_suppkey and o.l_shipdate > l.l_shipdate) group by 1",
)
_money("tpch_q22", "groupby([c_nationkey, count() as n, sum(c_acctbal) as total], [c_nationkey], filter(c_acctbal > (select([avg(b) as a], filter(b > 0.0, select([c_acctbal as b], customer)))) && not exists(filter(o_custkey = c_custkey, orders)), customer))", "select c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from customer c where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey) group by 1", "total")

# the SQL front-end
_sql("with_g1", "with big as (select o_custkey as k, count(*) as n from orders group by o_custkey) select k, n from big where n > 12", "orders")
_sql("outer_join_g3", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey", "customer orders")
_sql("full_join_g3", "select n_nationkey, s_suppkey from nation full outer join (select * from supplier where s_acctbal > 5000) s on n_nationkey = s_nationkey", "nation supplier")
_sql("group_having_g4", "select distinct p_brand, max(p_size) as m from part group by p_brand having count(*) > 10 order by p_brand", "part")
_sql("limit_offset_g5", "select n_nationkey from nation order by n_nationkey limit 5 offset 7", "nation")
_sql("like_g6", "select p_partkey from part where p_type like '%COPPER%' and p_name not like 'a%'", "part")
_sql("in_g7", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')) and o_orderstatus not in ('F')", "orders customer")
_sql("between_g8", "select p_partkey from part where p_size between 5 and 9 and p_brand is not null and p_type is distinct from 'x'", "part")
_sql("case_g9", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as s from orders", "orders")
_sql("exists_g10", "select s_suppkey from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)", "supplier lineitem")
_sql("count_distinct_g11", "select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag", "lineitem")
_sql("shifts_g12", "select n_nationkey, shiftleft(n_nationkey, 2) as l, shiftright(n_nationkey, 1) as r, ~n_nationkey as x from nation", "nation", "select n_nationkey, (n_nationkey::int << 2)::int as l, (n_nationkey::int >> 1)::int as r, (~n_nationkey::int)::int as x from nation")
_sql("regexp_g6", "select p_partkey from part where p_name rlike '^[a-f].*[0-9]$' or p_type rlike 'COPPER|TIN'", "part", "select p_partkey from part where regexp_matches(p_name, '^[a-f].*[0-9]$') or regexp_matches(p_type, 'COPPER|TIN')")
_sql("using_join_g3", "select c_custkey, o_orderkey from (select c_custkey, c_custkey as k from customer) right join (select o_orderkey, o_custkey as k from orders) using (k)", "customer orders")
_sql("cast_e11", "select cast(o_totalprice as bigint) as a, cast(o_orderkey as string) as b, cast('12' as int) as c from orders where o_totalprice = floor(o_totalprice) or o_orderkey < 100", "orders", "select cast(trunc(o_totalprice) as bigint) as a, cast(o_orderkey as varchar) as b, cast('12' as int) as c from orders where o_totalprice = floor(o_totalprice) or o_orderkey < 100")
_sql("bits_g12", "select n_nationkey, (n_nationkey & 6) as a, (n_nationkey | 1) as o, n_name || '!' as x from nation", "nation")
_sql("substring_g13", "select n_nationkey, substring(n_name, 2) as a, substring(n_name, 2, 3) as b, upper(n_name) as u from nation", "nation")
_sql("interval_g14", "select count(*) as n from orders where o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-01-01' + interval 3 month", "orders")
