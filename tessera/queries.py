"""The engine's registered queries over the test tables, and the equivalent SQL.

``lineitem`` stands for the (key, val) table with l_suppkey and l_quantity;
orders by o_orderkey and events by event_id stand for tables in batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bitmap
from tessera.operators import aggregate as agg
from tessera.operators import joins, membership, partitioning, profile
from tessera.plans import predicate as p
from tessera.plans import pruning
from tessera.sources.synthetic import SyntheticTable
from tessera.sources.tables import BATCH_ROWS, batch_of, key_value, table
from tessera.streaming.pipeline import stream_sum

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Workers that partition tables are made for: a parameter, so results don't depend on the machine.
THREADS = 12


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def _items(spark: SparkSession, d: str, key: str = "l_suppkey") -> DataFrame:
    return key_value(table(spark, d, "lineitem"), key, "l_quantity")


def _sum_sql(where: str, key: str = "l_suppkey", source: str = "lineitem", val: str = "CAST(l_quantity AS BIGINT)") -> str:
    return f"SELECT CAST({key} AS BIGINT) AS key, CAST(sum({val}) AS BIGINT) AS total FROM {source} WHERE {where} GROUP BY 1"


# --- threshold aggregation: shapes of the data, then plans -----------------------------------
def _threshold(name: str, key: str, limit: int) -> None:
    register(name, _sum_sql(f"CAST(l_quantity AS BIGINT) > {limit}", key))(lambda spark, d: agg.threshold_sum(_items(spark, d, key), limit))


for _name, _key, _limit in (
    ("threshold_sum", "l_suppkey", 25), ("threshold_sum_none", "l_suppkey", 1000), ("threshold_sum_all", "l_suppkey", -200), ("threshold_sum_high_sel", "l_suppkey", 5),
    ("threshold_sum_low_sel", "l_suppkey", 48), ("threshold_sum_few_keys", "l_linenumber", 25), ("threshold_sum_many_keys", "l_partkey", 25), ("threshold_sum_most_keys", "l_orderkey", 25),
):
    _threshold(_name, _key, _limit)


@register("threshold_sum_single_key", _sum_sql("l_quantity > 25", "7"))
def _single_key(spark, d):
    return agg.threshold_sum(key_value(table(spark, d, "lineitem"), F.lit(7), "l_quantity"), 25)


@register("threshold_sum_unaligned", _sum_sql("CAST(floor(o_totalprice) AS BIGINT) > 1000", "o_custkey", "orders", "CAST(floor(o_totalprice) AS BIGINT)"))
def _unaligned(spark, d):
    return agg.threshold_sum(key_value(table(spark, d, "orders"), "o_custkey", F.floor("o_totalprice")), 1000)


@register("threshold_sum_negative", _sum_sql("CAST(l_quantity AS BIGINT) - 50 > -30", val="CAST(l_quantity AS BIGINT) - 50"))
def _negative(spark, d):
    return agg.threshold_sum(key_value(table(spark, d, "lineitem"), "l_suppkey", F.col("l_quantity").cast("long") - 50), -30)


@register("threshold_sum_selected", _sum_sql("l_quantity > 25 AND l_returnflag <> 'R'"))
def _selected(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("key"), F.col("l_quantity").cast("long").alias("val"), "l_returnflag")
    return agg.selected_sum(lines, (F.col("val") > 25) & (F.col("l_returnflag") != "R"))


@register("threshold_sum_two_phase", ORACLE_SQL["threshold_sum"])
def _two_phase(spark, d):
    parts = agg.partial_sums(_items(spark, d), F.pmod(F.xxhash64("key", "val"), F.lit(8)), 25)
    return agg.merge_partials(parts)


@register("threshold_sum_range_partitioned", ORACLE_SQL["threshold_sum_many_keys"])
def _range_partitioned(spark, d):
    return agg.range_partitioned_sum(_items(spark, d, "l_partkey"), 25, 4 * spark.sparkContext.defaultParallelism)


@register("threshold_sum_adaptive", ORACLE_SQL["threshold_sum_many_keys"])
def _adaptive(spark, d):
    return agg.adaptive_sum(_items(spark, d, "l_partkey"), 25)


@register("threshold_sum_stream", ORACLE_SQL["threshold_sum"])
def _stream(spark, d):
    return stream_sum(spark, f"{d}/lineitem.parquet", F.col("l_suppkey"), F.col("l_quantity"), 25)


@register("partial_sums_by_batch", f"SELECT o_orderkey // {BATCH_ROWS} AS part, o_custkey AS key, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS partial FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) > 1000 GROUP BY 1, 2")
def _partials(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.floor("o_totalprice").alias("val"))
    return agg.partial_sums(orders, batch_of("o_orderkey"), 1000)


@register("merged_partials", "SELECT key, CAST(sum(v) AS BIGINT) AS total FROM (VALUES (1, 10), (2, 20), (2, 30), (3, 40)) t(key, v) GROUP BY key")
def _merged(spark, d):
    one, two = (spark.createDataFrame(x, "key int, partial long") for x in ([(1, 10), (2, 20)], [(2, 30), (3, 40)]))
    return agg.merge_partials(one, two)


@register("first_groups", _sum_sql("l_quantity > 25") + " ORDER BY key LIMIT 10")
def _first(spark, d):
    return agg.first_groups(agg.threshold_sum(_items(spark, d), 25))


_SYNTHETIC_SQL = "SELECT 10 AS groups, CAST(100000 AS BIGINT) AS n, TRUE AS keys_in_range, TRUE AS values_in_range, TRUE AS values_vary"


@register("generated_template", _SYNTHETIC_SQL)
def _generated(spark, d):
    t = SyntheticTable(rows=100_000, keys=10, low=-100, high=100).read(spark)
    return t.agg(
        F.count_distinct("key").cast("int").alias("groups"), F.count("*").alias("n"), ((F.min("key") == 0) & (F.max("key") == 9)).alias("keys_in_range"),
        ((F.min("val") >= -100) & (F.max("val") < 100)).alias("values_in_range"), (F.count_distinct("val") == 200).alias("values_vary"),
    )


@register("generated_sum", f"SELECT CAST(key AS BIGINT) AS key, CAST(sum(val) AS BIGINT) AS total FROM ({SyntheticTable(rows=1_000_000).sql()}) t WHERE val > 500 GROUP BY 1")
def _generated_sum(spark, d):
    return agg.threshold_sum(SyntheticTable(rows=1_000_000).read(spark), 500)


# --- predicates ------------------------------------------------------------------------------
_C0, _C1 = p.Col(0), p.Col(1)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("col0"), F.floor("value").alias("col1"), "event_id", "event_type")


_EVENTS_SQL = "SELECT event_id FROM (SELECT user_id AS col0, CAST(floor(value) AS BIGINT) AS col1, event_id, event_type FROM events) t WHERE "


def _predicate(name: str, node: p.Node, sql: str, selection: str | None = None) -> None:
    register(name, _EVENTS_SQL + sql)(lambda spark, d: p.select(_events(spark, d), node, F.expr(selection) if selection else None).select("event_id"))


def _op(sign: str, a: p.Node | int, b: p.Node | int) -> p.Op:
    node = lambda x: x if isinstance(x, p.Node) else p.Lit(x)
    return p.Op(sign, node(a), node(b))


for _name, _sign in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _predicate(f"pred_{_name}", _op(_sign, _C0, 70), f"col0 {_sign} 70")
_LONG = tuple(range(0, 150, 13))
_predicate("pred_literal_left", _op("<", 112, _C0), "112 < col0")
_predicate("pred_column_truthy", _C0, "col0 <> 0")
_predicate("pred_literal_truthy", p.And((p.Lit(5), p.Lit(True), _op("<", _C0, 9))), "col0 < 9")
_predicate("pred_literal_null", p.Or((p.Lit(None), p.Lit(0.0), _op("<", _C0, 9))), "col0 < 9")
_predicate("pred_not", p.Not(_op(">=", _C0, 93)), "NOT (col0 >= 93)")
_predicate("pred_and", p.And((_op(">", _C0, 37), _op("<", _C1, 44))), "col0 > 37 AND col1 < 44")
_predicate("pred_or", p.Or((_op("<", _C0, 20), _op(">", _C0, 130))), "col0 < 20 OR col0 > 130")
_predicate("pred_empty_and", p.And(()), "TRUE")
_predicate("pred_empty_or", p.Or(()), "FALSE")
_predicate("pred_nested", p.Or((p.And((_op(">", _C0, 118), _op("<", _C1, 36))), _op("=", _C0, 7))), "(col0 > 118 AND col1 < 36) OR col0 = 7")
_predicate("pred_selection_mask", _op(">", _C0, 64), "event_type = 'click' AND col0 > 64", "event_type = 'click'")
_predicate("pred_in_small", p.In(0, (88, 12, 5, 88)), "col0 IN (5, 12, 88)")
_predicate("pred_in_one", p.In(0, (7, 7)), "col0 = 7")
_predicate("pred_in_large", p.In(0, _LONG), f"col0 IN {_LONG}")
_predicate("pred_in_empty", p.In(0, ()), "FALSE")
_predicate("pred_not_in", p.Not(p.In(0, _LONG)), f"col0 NOT IN {_LONG}")
_predicate("pred_col_col", _op(">", _C0, _C1), "col0 > col1")
_predicate("pred_arith_compare", _op(">", _op("+", _C0, 5), _op("*", _C1, 2)), "col0 + 5 > col1 * 2")
_predicate("pred_f64_literal", _op(">", _C0, 99.5), "col0 > 99.5")
_predicate("arith_columns_add", _op(">", _op("+", _C0, _C1), 90), "col0 + col1 > 90")
_predicate("arith_columns_sub", _op("-", _C0, _C1), "col0 - col1 <> 0")
_predicate("arith_columns_mul", _op("<", _op("*", _C0, _C1), 700), "col0 * col1 < 700")
_predicate("arith_columns_div", _op("=", _op("/", _C0, _C1), 2), "col1 <> 0 AND col0 // (CASE WHEN col1 = 0 THEN 1 ELSE col1 END) = 2")
_predicate("fold_f64", _op(">", _C0, _op("+", 49.25, 50.5)), "col0 > 49.25 + 50.5")
_predicate("fold_f64_chain", _op(">", _C0, _op("/", _op("*", _op("-", 30.5, 0.5), 9.0), 4.0)), "col0 > (30.5 - 0.5) * 9.0 / 4.0")
_predicate("fold_f64_compare", p.And((_op("<", 2.25, 3.5), _op("<", _C0, 21))), "2.25 < 3.5 AND col0 < 21")
_predicate("fold_bool_eq", p.And((_op("=", True, True), _op("<", _C0, 33))), "(TRUE = TRUE) AND col0 < 33")
_predicate("fold_bool_ne", p.Or((_op("!=", False, False), _op("<", _C0, 33))), "(FALSE <> FALSE) OR col0 < 33")
_predicate("pred_null_literal", p.Not(_op("=", _C0, p.Lit(None))), "TRUE")
_predicate("arith_add", _op("+", _C0, -30), "col0 + -30 <> 0")
_predicate("arith_sub", _op("-", _C0, 30), "col0 - 30 <> 0")
_predicate("arith_sub_literal_left", _op("-", 30, _C0), "30 - col0 <> 0")
_predicate("arith_mul", _op("*", _C0, 12), "col0 * 12 <> 0")
_predicate("arith_mul_zero", _op("*", _C0, 0), "col0 * 0 <> 0")
_predicate("arith_div", _op("/", _C0, -40), "col0 // 40 <> 0")
_predicate("arith_div_zero", _op("/", _C0, 0), "FALSE")
_predicate("arith_div_literal_left", _op("/", 40, _C0), "col0 <> 0 AND 40 // (CASE WHEN col0 = 0 THEN 1 ELSE col0 END) <> 0")
_predicate("arith_div_compare", _op("=", _op("/", _C0, 7), 3), "col0 // 7 = 3")
_NESTED = p.Not(p.Or((p.Not(p.And((_op(">", _C0, 37), p.Lit(True), p.And((_op("<", _C1, 44),))))), p.In(0, (61,)), _op(">", 3, 5))))
_predicate("simplify_equivalence", _NESTED, "col0 > 37 AND col1 < 44 AND col0 <> 61")
_EDGES = (2**63 - 1, -(2**63), 3037000500, -1, 0, 7)


def _wrapped(sign: str) -> str:
    """DuckDB SQL of a + b, a - b or a * b in 64 bits, by way of 128."""
    exact = f"CAST(a AS HUGEINT) {sign} b"
    rest = f"((({exact}) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616)"
    return f"CAST(CASE WHEN {rest} >= 9223372036854775808 THEN {rest} - 18446744073709551616 ELSE {rest} END AS BIGINT)"


_EDGE_ROWS = ", ".join(f"(CAST('{a}' AS BIGINT), CAST('{b}' AS BIGINT))" for a in _EDGES for b in _EDGES)


@register("arith_wraps", f"SELECT a, b, {_wrapped('+')} AS plus, {_wrapped('-')} AS minus, {_wrapped('*').replace('CAST(a AS HUGEINT) * b', '(CAST(a AS HUGEINT) * b)')} AS times FROM (VALUES {_EDGE_ROWS}) t(a, b)")
def _wraps(spark, d):
    df = spark.createDataFrame([(a, b) for a in _EDGES for b in _EDGES], "a long, b long")
    return df.select("a", "b", *[p.value(_op(sign, _C0, _C1), df).alias(name) for sign, name in (("+", "plus"), ("-", "minus"), ("*", "times"))])


@register("fold_text", "SELECT '6.000000' AS product, '-3' AS quotient, 'inf' AS over_zero, 'false' AS unequal, '(1 < 2.000000)' AS mixed, '(7 / 0)' AS waits, '-9223372036854775808' AS wrapped")
def _fold_text(spark, d):
    cases = {"product": _op("*", 2.5, 2.4), "quotient": _op("/", -7, 2), "over_zero": _op("/", 1.0, 0.0), "unequal": _op("!=", True, True), "mixed": _op("<", 1, 2.0), "waits": _op("/", 7, 0), "wrapped": _op("/", -(2**63), -1)}
    return spark.createDataFrame([tuple(p.text(p.simplify(n)) for n in cases.values())], ", ".join(f"{k} string" for k in cases))

_NULLS = "(VALUES (1, 5), (2, NULL), (3, 0), (4, -7))"


@register("pred_null_not", f"SELECT id FROM {_NULLS} t(id, v) WHERE NOT coalesce(v > 0, FALSE)")
def _null_not(spark, d):
    df = spark.createDataFrame([(5, 1), (None, 2), (0, 3), (-7, 4)], "v long, id int")
    return p.select(df, p.Not(_op(">", _C0, 0))).select("id")


@register("pred_null_truthy", f"SELECT id FROM {_NULLS} t(id, v) WHERE coalesce(v <> 0, FALSE)")
def _null_truthy(spark, d):
    return p.select(spark.createDataFrame([(5, 1), (None, 2), (0, 3), (-7, 4)], "v long, id int"), _C0).select("id")


@register("pred_text", "SELECT '(((col0 > 118) AND (col1 < 36)) OR (col0 = 7))' AS nested, 'NOT (col0 IN (4, 9))' AS negated, '(col0 * 2.500000)' AS product, 'true' AS nothing")
def _text(spark, d):
    nested = p.Or((p.And((_op(">", _C0, 118), _op("<", _C1, 36))), _op("=", _C0, 7)))
    row = (p.text(nested), p.text(p.Not(p.In(0, (4, 9)))), p.text(_op("*", _C0, 2.5)), p.text(p.And(())))
    return spark.createDataFrame([row], "nested string, negated string, product string, nothing string")


# --- joins -----------------------------------------------------------------------------------
def _orders_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("payload"))
    return orders, lines


@register("join_inner", "SELECT o_orderkey AS key, o_custkey AS lp, l_partkey AS rp FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _inner(spark, d):
    return joins.inner_join(*_orders_lines(spark, d))


@register("join_left_outer", "SELECT o_orderkey AS key, o_custkey AS lp, l_partkey AS rp FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def _left_outer(spark, d):
    return joins.left_outer_join(*_orders_lines(spark, d))


_L, _R = [(1, 10), (1, 11), (2, 20), (2, 21), (2, 22), (9, 90)], [(1, 100), (1, 101), (2, 200), (2, 201), (7, 700)]
_SIDES_SQL = "SELECT l.key, l.payload AS lp, r.payload AS rp FROM (VALUES {}) l(key, payload) {} JOIN (VALUES {}) r(key, payload) ON l.key = r.key"
_values = lambda rows: ", ".join(map(str, rows))


@register("join_inner_dups", _SIDES_SQL.format(_values(_L), "", _values(_R)))
def _inner_dups(spark, d):
    return joins.inner_join(*(spark.createDataFrame(x, "key int, payload int") for x in (_L, _R)))


@register("join_left_outer_dups", _SIDES_SQL.format(_values(_L), "LEFT", _values(_R)))
def _left_dups(spark, d):
    return joins.left_outer_join(*(spark.createDataFrame(x, "key int, payload int") for x in (_L, _R)))


# --- zone maps -------------------------------------------------------------------------------
_ZONES_SQL = f"SELECT o_orderkey // {BATCH_ROWS} AS batch_id, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_custkey) AS clo, max(o_custkey) AS chi FROM orders GROUP BY 1"


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return pruning.zone_map(table(spark, d, "orders"), batch_of("o_orderkey"), ["o_orderkey", "o_custkey"])


@register("zone_map", f"SELECT batch_id, n, lo AS min_o_orderkey, hi AS max_o_orderkey, clo AS min_o_custkey, chi AS max_o_custkey FROM ({_ZONES_SQL}) z")
def _zone_map(spark, d):
    return _zones(spark, d)


_O = ["o_orderkey", "o_custkey"]
_PRUNE = {
    "gt": (_op(">", _C0, 7000), "hi <= 7000"), "ge": (_op(">=", _C0, 6144), "hi < 6144"), "lt": (_op("<", _C0, 4096), "lo >= 4096"), "le": (_op("<=", _C0, 4095), "lo > 4095"),
    "eq": (_op("=", _C0, 5000), "5000 < lo OR 5000 > hi"), "ne": (_op("!=", _C0, 5000), "FALSE"), "flipped": (_op("<", 7000, _C0), "hi <= 7000"),
    "in_list": (p.In(0, (10, 9000)), "(10 < lo OR 10 > hi) AND (9000 < lo OR 9000 > hi)"), "in_empty": (p.In(0, ()), "TRUE"),
    "conj": (p.And((_op(">", _C0, 4000), _op("<", _C0, 6000))), "hi <= 4000 OR lo >= 6000"), "disj": (p.Or((_op("<", _C0, 4000), _op(">", _C0, 9000))), "lo >= 4000 AND hi <= 9000"),
    "negated": (p.Not(_op(">", _C0, 7000)), "FALSE"), "never": (_op("=", _C1, 5), "5 < clo OR 5 > chi"), "column": (_C0, "FALSE"), "no_arms": (p.Or(()), "TRUE"),
}


@register("prune_decisions", f"SELECT batch_id, {', '.join(f'({sql}) AS {name}' for name, (_, sql) in _PRUNE.items())} FROM ({_ZONES_SQL}) z")
def _decisions(spark, d):
    return _zones(spark, d).select("batch_id", *[pruning.prunable(node, _O).alias(name) for name, (node, _) in _PRUNE.items()])


@register("prune_then_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 9000")
def _prune_scan(spark, d):
    orders, node = table(spark, d, "orders").select(*_O), _op(">", _C0, 9000)
    return p.select(pruning.scan_unpruned(orders, batch_of("o_orderkey"), _zones(spark, d), node, _O).select(*_O), node)


@register("prune_never", "SELECT count(*) AS batches, CAST(count(*) FILTER (top <= 0) AS BIGINT) AS pruned FROM (SELECT event_id // 2048 AS b, max(user_id) AS top FROM events GROUP BY 1) t")
def _prune_never(spark, d):
    zones = pruning.zone_map(table(spark, d, "events"), batch_of("event_id"), ["user_id"])
    return zones.agg(F.count("*").alias("batches"), F.count_if(pruning.prunable(_op(">", _C0, 0), ["user_id"])).alias("pruned"))


# --- key ranges ------------------------------------------------------------------------------
_PASSING = "(SELECT CAST(l_partkey AS BIGINT) AS key, CAST(l_quantity AS BIGINT) AS val FROM lineitem)"
_SPAN = f"t AS (SELECT * FROM {_PASSING} s), s AS (SELECT min(key) AS lo, max(key) AS hi FROM t)"
_BUCKETS = f"""
    {_SPAN}, w AS (SELECT lo, hi, greatest(1, least({16 * THREADS}, hi - lo + 1)) AS nb FROM s), v AS (SELECT *, greatest(1, (hi - lo + 1) // nb) AS width FROM w),
    c AS (SELECT CAST(least((key - lo) // width, nb - 1) AS INT) AS bucket, count(*) AS n FROM t, v GROUP BY 1),
    h AS (SELECT CAST(i AS INT) AS bucket, lo + i * width AS lo, CASE WHEN i = nb - 1 THEN hi + 1 ELSE lo + (i + 1) * width END AS hi, coalesce(n, 0) AS n
          FROM v, (SELECT unnest(range({16 * THREADS})) AS i) r LEFT JOIN c ON c.bucket = i WHERE i < nb)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "l_partkey")


@register("range_partitions", f"WITH {_SPAN}, w AS (SELECT lo, hi, least({4 * THREADS}, hi - lo + 1) AS np FROM s), v AS (SELECT lo, np, greatest(1, (hi - lo + 1) // np) AS width FROM w) SELECT CAST(least((key - lo) // width, np - 1) AS INT) AS part, count(*) AS n, CAST(sum(val) AS BIGINT) AS total FROM t, v GROUP BY 1")
def _ranges(spark, d):
    return partitioning.range_partitions(_parts(spark, d), THREADS)


@register("density_histogram", f"WITH {_BUCKETS} SELECT bucket, lo, hi, n FROM h")
def _histogram(spark, d):
    return partitioning.density_histogram(_parts(spark, d), THREADS)


def _size_sql(small: str, large: str) -> str:
    return f"CASE WHEN n / (hi - lo) >= 8 THEN {small} WHEN n / (hi - lo) <= 1 THEN {large} ELSE least(greatest(CAST(round({small} + (8 - n / (hi - lo)) / 7 * ({large} - {small})) AS BIGINT), {small}), {large}) END"


@register("adaptive_sizes", f"WITH {_BUCKETS} SELECT bucket, n, hi - lo AS keys, CAST({_size_sql('2', '12')} AS BIGINT) AS size FROM h")
def _sizes(spark, d):
    return partitioning.adaptive_sizes(partitioning.density_histogram(_parts(spark, d), THREADS), 2, 12)


_ADAPTIVE_SQL = f"""
    WITH {_BUCKETS}, z AS (SELECT greatest((hi - lo + 1) // {8 * THREADS}, 1) AS small, greatest((hi - lo + 1) // {THREADS}, 1) AS large FROM s),
    b AS (SELECT bucket, lo, hi, (hi - lo) * {partitioning.SHARE} // CAST({_size_sql('small', 'large')} AS BIGINT) AS share FROM h, z),
    f AS (SELECT lo, hi, coalesce(sum(share) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {partitioning.SHARE} AS place FROM b),
    q AS (SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS part, min(lo) AS lo, max(hi) AS hi FROM f GROUP BY place)
    SELECT part, q.lo, q.hi, count(key) AS n, CAST(sum(val) AS BIGINT) AS total FROM q LEFT JOIN t ON key >= q.lo AND key < q.hi GROUP BY 1, 2, 3"""


@register("adaptive_partitions", _ADAPTIVE_SQL)
def _adaptive_partitions(spark, d):
    return partitioning.adaptive_partitions(_parts(spark, d), THREADS)


# --- selection bitmaps -----------------------------------------------------------------------
def _bits(spark: SparkSession, d: str, where: str) -> DataFrame:
    events = table(spark, d, "events").filter(where)
    return bitmap.from_positions(events, batch_of("event_id"), F.col("event_id") % BATCH_ROWS)


def _words_sql(where: str, pos: str = "pos") -> str:
    rows = f"(SELECT event_id // {BATCH_ROWS} AS batch_id, event_id % {BATCH_ROWS} AS pos, * FROM events) e"
    return f"SELECT batch_id, {pos} // 32 AS word_id, bit_or(CAST(1 AS BIGINT) << CAST({pos} % 32 AS BIGINT)) AS word FROM {rows} WHERE {where} GROUP BY 1, 2"


_A, _B = "user_id > 70", "event_type = 'click' OR user_id < 90"


@register("bitmap_words", _words_sql(_A))
def _words(spark, d):
    return _bits(spark, d, _A)


@register("bitmap_popcount", f"SELECT event_id // {BATCH_ROWS} AS batch_id, count(*) AS n FROM events WHERE {_A} GROUP BY 1")
def _popcount(spark, d):
    return bitmap.popcount(_bits(spark, d, _A))


@register("bitmap_positions", f"SELECT event_id // {BATCH_ROWS} AS batch_id, event_id % {BATCH_ROWS} AS pos FROM events WHERE {_A}")
def _positions(spark, d):
    return bitmap.positions(_bits(spark, d, _A))


@register("bitmap_and", _words_sql(f"({_A}) AND ({_B})"))
def _and(spark, d):
    return bitmap.both(_bits(spark, d, _A), _bits(spark, d, _B))


@register("bitmap_or", _words_sql(f"({_A}) OR ({_B})"))
def _or(spark, d):
    return bitmap.either(_bits(spark, d, _A), _bits(spark, d, _B))


def _frame(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every batch, and the bits that a row of it stands for: the last batch is short."""
    return table(spark, d, "events").select(batch_of("event_id").alias("batch_id")), _bits(spark, d, "TRUE")


@register("bitmap_not", _words_sql(f"NOT coalesce({_A}, FALSE)"))
def _not(spark, d):
    batches, rows = _frame(spark, d)
    return bitmap.both(bitmap.complement(_bits(spark, d, _A), batches, BATCH_ROWS), rows)


@register("bitmap_all", f"SELECT event_id // {BATCH_ROWS} AS batch_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _all(spark, d):
    batches, rows = _frame(spark, d)
    return bitmap.popcount(bitmap.both(bitmap.all_set(batches, BATCH_ROWS), rows))


@register("bitmap_shl", _words_sql(f"({_A}) AND pos + 37 < {BATCH_ROWS}", "(pos + 37)"))
def _shl(spark, d):
    return bitmap.shifted(_bits(spark, d, _A), 37, BATCH_ROWS)


@register("bitmap_shr", _words_sql(f"({_A}) AND pos >= 37", "(pos - 37)"))
def _shr(spark, d):
    return bitmap.shifted(_bits(spark, d, _A), -37, BATCH_ROWS)


@register("bitmap_shift_out", "SELECT CAST(0 AS BIGINT) AS n")
def _shift_out(spark, d):
    return bitmap.shifted(_bits(spark, d, _A), BATCH_ROWS, BATCH_ROWS).agg(F.count("*").alias("n"))


@register("bitmap_set_clear", _words_sql(f"({_A}) AND event_id <> 64 OR event_id = 63"))
def _set_clear(spark, d):
    return bitmap.with_bit(bitmap.with_bit(_bits(spark, d, _A), 0, 63), 0, 64, on=False)


_ASKED = [(0, 63), (0, 64), (0, 31), (0, 32), (1, 0), (1, 2047), (10**6, 5)]


@register("bitmap_has_bit", f"SELECT batch_id, pos, EXISTS (SELECT 1 FROM events WHERE event_id = batch_id * {BATCH_ROWS} + pos AND {_A}) AS is_set FROM (VALUES {', '.join(f'(CAST({b} AS BIGINT), CAST({k} AS BIGINT))' for b, k in _ASKED)}) t(batch_id, pos)")
def _has_bit(spark, d):
    return bitmap.has_bits(_bits(spark, d, _A), spark.createDataFrame(_ASKED, "batch_id long, pos long"))


# --- membership ------------------------------------------------------------------------------
_RATE = 0.01
_NATURAL = "o_orderstatus = 'F'"


def _probed(spark: SparkSession, d: str, built: str, probed: str) -> DataFrame:
    """o_orderkey and maybe of the orders ``probed``, by a filter of the keys of the orders ``built``."""
    keys = table(spark, d, "orders").filter(built)
    shape = membership.BloomShape.of(keys.count(), _RATE)
    words = membership.bloom_build(keys, "o_orderkey", shape)
    return membership.with_maybe(table(spark, d, "orders").filter(probed).select("o_orderkey"), "o_orderkey", words, shape)


@register("bloom_no_false_negatives", "SELECT count(*) AS probes, CAST(0 AS BIGINT) AS misses FROM orders")
def _no_misses(spark, d):
    return _probed(spark, d, "TRUE", "TRUE").agg(F.count("*").alias("probes"), F.count_if(F.col("o_orderkey").isNotNull() & ~F.col("maybe")).alias("misses"))


@register("bloom_false_positive_rate", "SELECT TRUE AS under_five_percent")
def _false_positives(spark, d):
    return _probed(spark, d, _NATURAL, f"NOT ({_NATURAL})").agg(((F.count("*") == 0) | (F.count_if("maybe") < 0.05 * F.count("*"))).alias("under_five_percent"))


@register("bloom_semi_filter", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_NATURAL})")
def _bloom_semi(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return membership.bloom_semi_join(lines, table(spark, d, "orders").filter(_NATURAL).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", _RATE)


_PRICES = range(1000, 90_000, 23)


@register("in_list_long", f"SELECT o_orderkey FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) IN ({', '.join(map(str, _PRICES))})")
def _in_long(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"))
    return membership.in_list(orders, "price", list(_PRICES)).select("o_orderkey")


# --- measurement -----------------------------------------------------------------------------
_POINTS_SQL = ", ".join(f"quantile_disc(value, {q}) AS {name}" for name, q in profile.POINTS.items())


@register("latency_quantiles", f"SELECT event_type, count(value) AS n, {_POINTS_SQL}, max(value) AS max FROM events GROUP BY 1")
def _latency(spark, d):
    return profile.latency_report(table(spark, d, "events"), "value", ["event_type"])


@register("observed_counts", "SELECT count(*) AS rows_read, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS rows_passed FROM lineitem")
def _observed(spark, d):
    rows, watch = profile.observed(_items(spark, d), "scan", rows_read=F.count("*"), rows_passed=F.count_if(F.col("val") > 25))
    agg.threshold_sum(rows, 25).write.format("noop").mode("overwrite").save()
    got = watch.get
    return spark.createDataFrame([(got["rows_read"], got["rows_passed"])], "rows_read long, rows_passed long")


@register("latency_quantiles_approx", "SELECT event_type, count(value) AS n, max(value) AS max, TRUE AS p50_close, TRUE AS p99_close FROM events GROUP BY 1")
def _latency_approx(spark, d):
    """The summaries of bounded size, beside the exact values a hundredth of the ranks below and above."""
    near = {name: [f"percentile_disc({max(0.0, q - 0.01)}) WITHIN GROUP (ORDER BY value)", f"percentile_disc({min(1.0, q + 0.01)}) WITHIN GROUP (ORDER BY value)"] for name, q in (("p50", 0.5), ("p99", 0.99))}
    events = table(spark, d, "events")
    exact = events.groupBy("event_type").agg(*[F.expr(sql).alias(f"{name}_{k}") for name, pair in near.items() for k, sql in enumerate(pair)])
    found = profile.latency_report(events, "value", ["event_type"], accuracy=10_000).join(exact, "event_type")
    return found.select("event_type", "n", "max", *[F.col(name).between(F.col(f"{name}_0"), F.col(f"{name}_1")).alias(f"{name}_close") for name in near])


@register("profiled_sums", f"SELECT plan, (SELECT count(*) FROM lineitem) AS rows_read, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS rows_passed, count(*) AS groups, CAST(sum(total) AS BIGINT) AS total, TRUE AS timed FROM ({ORACLE_SQL['threshold_sum']}) t, (VALUES ('two-phase'), ('key ranges'), ('rebalanced')) p(plan) GROUP BY plan")
def _profiled(spark, d):
    plans = {"two-phase": lambda df: agg.threshold_sum(df, 25), "key ranges": lambda df: agg.range_partitioned_sum(df, 25, 8), "rebalanced": lambda df: agg.adaptive_sum(df, 25)}
    rows = [profile.profiled(_items(spark, d), plan, name, F.col("val") > 25) for name, plan in plans.items()]
    out = [(r.plan, r.rows_read, r.rows_passed, r.groups, r.total, r.plan_ns >= 0 and r.execute_ns > 0) for r in rows]
    return spark.createDataFrame(out, "plan string, rows_read long, rows_passed long, groups long, total long, timed boolean")


@register("stage_report", "SELECT stage, CAST(n AS BIGINT) AS n, TRUE AS ordered FROM (VALUES ('plan', 3), ('execute', 3)) t(stage, n)")
def _stages(spark, d):
    """Timers around planning and execution of a plan run three times: samples of each stage, percentiles in order."""
    latencies = profile.Latencies()
    profile.instrumented(lambda: agg.threshold_sum(_items(spark, d), 25), latencies, repeats=3)
    points = {stage: [latencies.percentile(stage, q) for q in profile.POINTS.values()] for stage in latencies.samples}
    return spark.createDataFrame([(stage, len(ns), points[stage] == sorted(points[stage]) and points[stage][-1] <= max(ns)) for stage, ns in latencies.samples.items()], "stage string, n long, ordered boolean")


@register("environment", "SELECT TRUE AS counts_grow, TRUE AS decided")
def _environment(spark, d):
    before = profile.Environment.now()
    agg.threshold_sum(_items(spark, d), 25).write.format("noop").mode("overwrite").save()
    after = profile.Environment.now()
    grow = after.voluntary >= before.voluntary and after.involuntary >= before.involuntary and after.interrupts >= before.interrupts
    return spark.createDataFrame([(grow, all(isinstance(x, bool) for x in before.clean_until(after)))], "counts_grow boolean, decided boolean")


@register("plan_report", "SELECT line, TRUE AS present FROM (VALUES ('two-phase'), ('key ranges'), ('rebalanced'), ('largest sums')) t(line)")
def _report(spark, d):
    from tessera.report import run

    lines = run(spark, rows=50_000, keys=20, threshold=500, repeats=1)
    names = ("two-phase", "key ranges", "rebalanced", "largest sums")
    return spark.createDataFrame([(n, any(x.startswith(f"{n}: ") for x in lines)) for n in names], "line string, present boolean")
