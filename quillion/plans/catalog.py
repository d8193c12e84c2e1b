"""The query catalogue: what the driver runs, and the SQL it compares with.

Most queries are SQL in the engine's own dialect, where ``{table}`` stands for a table: the engine gets the Parquet
file's path as a literal, the comparison gets the table's name. Some run operators, readers or sinks directly.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..api import Query
from ..functions import dialect
from ..operators import relational as ops
from ..operators.relational import Aggregate, Condition, SortKey
from ..session import shared_folder
from ..sources.resolve import resolve
from ..streaming import events as streams

FLAGSHIP = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, SUM(l_quantity) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price
FROM {lineitem} WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""

SQL = {
    "flagship": FLAGSHIP,
    "scan_project": "SELECT n_name, n_nationkey FROM {nation}",
    "select_star": "SELECT * FROM {region}",
    "filter_conj": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_discount > 0.05 AND l_returnflag = 'R'",
    "filter_not_equal": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus <> 'O' AND o_totalprice != 0 AND o_totalprice <= 50000",
    "filter_or_in_between_like": """SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders}
        WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority LIKE '5%') AND o_totalprice BETWEEN 1000 AND 90000 AND NOT (o_orderstatus = 'P')""",
    "filter_null": "SELECT o_orderkey FROM {orders} WHERE o_orderdate IS NOT NULL AND NOT o_custkey IS NULL",
    "filter_dates": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= '1995-01-01 00:00:00' AND o_orderdate < '1996-07-01 00:00:00'",
    "order_limit_topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "order_nulls_last": """SELECT k, x, row_number() OVER (PARTITION BY c ORDER BY x, k) AS pos FROM
        (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS x FROM {orders}) t""",
    "limit_zero": "SELECT r_regionkey, r_name FROM {region} LIMIT 0",
    "group_multi_agg": """SELECT l_returnflag, l_shipdate IS NULL AS unshipped, COUNT(*) AS cnt, COUNT(l_tax) AS taxed, SUM(l_quantity) AS qty,
        ROUND(AVG(l_discount), 6) AS disc, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM {lineitem} GROUP BY l_returnflag, l_shipdate IS NULL""",
    "global_agg": "SELECT COUNT(*) AS cnt, SUM(l_quantity) AS qty, ROUND(AVG(l_tax), 6) AS tax, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM {lineitem}",
    "group_having": "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12 AND total > 100",
    "group_without_agg": "SELECT o_orderstatus, o_orderpriority FROM {orders} GROUP BY o_orderstatus, o_orderpriority",
    "group_ordinal": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY 1, 2 ORDER BY 1, 2",
    "count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM {lineitem} GROUP BY l_returnflag",
    "stats_agg": """SELECT p_brand, ROUND(STDDEV(p_retailprice), 6) AS sd, ROUND(VARIANCE(p_retailprice), 4) AS va, ROUND(MEDIAN(p_retailprice), 6) AS med,
        ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY p_retailprice), 6) AS p90 FROM {part} GROUP BY p_brand""",
    "join_inner": "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE o_totalprice > 300000",
    "join_left": """SELECT c_custkey, o_orderkey FROM {customer} c LEFT JOIN (SELECT o_custkey, o_orderkey FROM {orders} WHERE o_orderstatus = 'P') o
        ON c.c_custkey = o.o_custkey""",
    "join_right": "SELECT o_orderkey, c_custkey FROM (SELECT * FROM {orders} WHERE o_totalprice > 400000) o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "join_full": """SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT * FROM {nation} WHERE n_regionkey < 3) a
        FULL OUTER JOIN (SELECT * FROM {nation} WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey""",
    "join_cross": "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}",
    "join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_null_keys": """SELECT COUNT(*) AS n FROM (SELECT CASE WHEN n_nationkey > 5 THEN n_nationkey END AS k FROM {nation}) a
        JOIN (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END AS k FROM {nation}) b ON a.k = b.k""",
    "join_multiway": """SELECT r_name, n_name, COUNT(*) AS items, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {region} r
        JOIN {nation} n ON r.r_regionkey = n.n_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey
        JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE o_orderstatus = 'F' GROUP BY r_name, n_name""",
    "join_expr_key": "SELECT p_partkey, n_name FROM {part} p JOIN {nation} n ON UPPER(SUBSTRING(p.p_type, 1, 2)) = UPPER(SUBSTRING(n.n_name, 1, 2)) WHERE p_size > 45",
    "join_theta": "SELECT a.r_name AS a_name, b.r_name AS b_name FROM {region} a JOIN {region} b ON a.r_regionkey < b.r_regionkey",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "case_when": """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
        CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS flag FROM {part}""",
    "cast_exprs": """SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(FLOOR(p_retailprice) AS INTEGER) AS i, CAST(p_partkey AS STRING) AS s,
        CAST('2024-02-29' AS DATE) AS day FROM {part} WHERE p_retailprice = ROUND(p_retailprice, 0)""",
    "arith_alias": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, 'item' AS kind, l_linenumber / 2 AS half FROM {lineitem}",
    "scalar_subquery_select": "SELECT n_name, (SELECT COUNT(*) FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey) AS suppliers FROM {nation} n",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 0",
    "cte_chain": """WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000),
        per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN {customer} ON c_custkey = o_custkey WHERE n >= 2""",
    "subquery_from": "SELECT status, n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM {orders} GROUP BY o_orderstatus) t WHERE n > 10",
    "subquery_scalar": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM {orders})",
    "subquery_correlated": """SELECT p_partkey, p_brand, p_retailprice FROM {part} p
        WHERE p_retailprice > (SELECT AVG(q.p_retailprice) * 1.2 FROM {part} q WHERE q.p_brand = p.p_brand)""",
    "subquery_in_exists": """SELECT c_custkey FROM {customer} c WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)
        AND EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""",
    "win_row_number": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}",
    "win_rank_dense": """SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS rk,
        CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS dr FROM {part}""",
    "win_lag_lead": """SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, LEAD(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt
        FROM {events}""",
    "win_first_last_nth": """SELECT event_id, FIRST_VALUE(value) OVER w AS f, LAST_VALUE(value) OVER w AS l, NTH_VALUE(value, 2) OVER w AS s FROM {events}
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_agg": """SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running,
        MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM {orders}""",
    "win_topn_per_group": """SELECT p_brand, p_partkey, p_retailprice FROM (SELECT p_brand, p_partkey, p_retailprice,
        ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM {part}) t WHERE rn <= 3""",
    "win_frame": """SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving,
        COUNT(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM {events}""",
    "win_over_group": """SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS mean, CAST(ROW_NUMBER() OVER (ORDER BY AVG(o_totalprice) DESC) AS BIGINT) AS pos
        FROM {orders} GROUP BY o_orderpriority""",
    "str_funcs": """SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, CAST(LENGTH(p_type) AS BIGINT) AS n, SUBSTRING(p_name, 1, 5) AS s, TRIM(CONCAT(' ', p_brand, NULL, ' ')) AS t,
        REPLACE(p_type, 'STEEL', 'IRON') AS r FROM {part}""",
    "split_regexp": "SELECT p_partkey, SPLIT(p_brand, '#') AS parts, REGEXP_MATCHES(p_type, '^[A-M].*(S|N)') AS hit FROM {part}",
    "date_extract_trunc": """SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m,
        CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS mon, CAST(DATE_TRUNC('week', o_orderdate) AS DATE) AS wk FROM {orders}""",
    "date_diff_add": """SELECT o_orderkey, DATE_DIFF('day', CAST('1995-01-15' AS DATE), CAST(o_orderdate AS DATE)) AS days,
        DATE_DIFF('month', CAST('1995-01-15' AS DATE), CAST(o_orderdate AS DATE)) AS months, DATE_DIFF('year', CAST('1995-01-15' AS DATE), CAST(o_orderdate AS DATE)) AS years,
        DATE_SUB('month', CAST('1995-01-31' AS DATE), CAST(o_orderdate AS DATE)) AS whole, DATE_SUB('year', CAST('1996-02-29' AS DATE), CAST(o_orderdate AS DATE)) AS wyears,
        CAST(DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 1 YEAR) AS DATE) AS nxt, CAST(CAST(o_orderdate AS DATE) - INTERVAL 90 DAY AS DATE) AS prv FROM {orders}""",
    "strftime": "SELECT STRFTIME(o_orderdate, '%Y-%m') AS ym, COUNT(*) AS n, MIN(STRFTIME(o_orderdate, 'on %d/%m/%y at %H:%M')) AS d FROM {orders} GROUP BY 1",
    "round_math": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice, 1) AS r, ROUND(l_quantity / 7, 3) AS q, CAST(l_orderkey % 7 AS BIGINT) AS m FROM {lineitem}",
    "inline_two_files": "SELECT n.n_name, r.r_name FROM {nation} AS n, {region} AS r WHERE n.n_regionkey = r.r_regionkey",
    "nested_any_all": "SELECT r_name FROM {region} WHERE r_regionkey NOT IN (SELECT n_regionkey FROM {nation} WHERE n_name LIKE '%A%')",
    "limit_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 35",
    "rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_filter": "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS big, SUM(l_quantity) FILTER (WHERE l_linestatus = 'F') AS qty FROM {lineitem} GROUP BY l_returnflag",
    "case_in_aggregate": "SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 1.0 / COUNT(*) > 0.3 AS often FROM {orders} GROUP BY o_orderpriority",
    "comments": """SELECT n_name, '-- no comment' AS t -- the name, and 'a literal'
        FROM /* all of */ {nation} WHERE n_name <> '/* x */' -- LIMIT 1""",
    "order_nulls_first": """SELECT k, x, row_number() OVER (PARTITION BY c ORDER BY x DESC NULLS FIRST, k) AS pos FROM
        (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS x FROM {orders}) t""",
    "win_distribution": """SELECT p_partkey, CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS quarter,
        ROUND(PERCENT_RANK() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS below, ROUND(CUME_DIST() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS upto FROM {part}""",
    "cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": """SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS BIGINT) AS g, COUNT(*) AS n FROM {lineitem}
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
    "semi_anti": "SELECT COUNT(*) AS n FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
}

#: Where the two engines' spellings differ beyond what the dialect covers.
ORACLE_ONLY = {
    "split_regexp": "SELECT p_partkey, string_split(p_brand, '#') AS parts, regexp_matches(p_type, '^[A-M].*(S|N)') AS hit FROM part",
}


def _engine(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return Query(spark=spark).sql(re.sub(r"\{(\w+)\}", lambda m: f"'{sf_dir}/{m[1]}.parquet'", sql)).df


def _sql_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir, sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return resolve(spark, f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quillion-{uuid.uuid4().hex}"


# operators, one by one


def op_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [Condition("l_quantity", ">", 40), Condition("l_returnflag", "=", "A"), Condition("l_linestatus", "!=", "x")]
    return ops.project(ops.filter_rows(_table(spark, sf_dir, "lineitem"), conditions), ["l_orderkey", "l_linenumber"])


def op_filter_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return ops.group_by(ops.filter_rows(part, [Condition("p_size", ">", "abc")]).unionByName(ops.filter_rows(part, [Condition("p_size", ">", "25")])), [], [Aggregate("COUNT", "*")])


def op_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [Aggregate("COUNT", "*"), Aggregate("SUM", "p_size"), Aggregate("AVG", "p_size", "mean"), Aggregate("MIN", "p_name"), Aggregate("MAX", "p_retailprice")]
    return ops.group_by(_table(spark, sf_dir, "part"), ["p_brand"], sums)


def op_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.project(ops.limit(ops.order_by(_table(spark, sf_dir, "customer"), [SortKey("c_acctbal", True), SortKey("c_custkey")]), 15), ["c_custkey", "c_acctbal"])


def op_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region").withColumnRenamed("r_name", "n_name")
    return ops.join(nation, region, "n_regionkey", "r_regionkey", "LEFT")


def op_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [SortKey("o_orderkey")], 2, 50)


def result_filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.result_contains(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "steel")


def result_filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.result_filter(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "regex", "^brand#[12]")


def result_filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.result_filter(ops.result_filter(_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), "p_size", "between", 10, 20), "p_type", "startswith", "p")


def json_text_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def dialect_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, start = F.col("o_orderdate").cast("date"), F.lit("1993-05-20").cast("date")
    orders = _table(spark, sf_dir, "orders")
    units = [dialect.date_diff(u, start, day).alias(u) for u in ("day", "week", "month", "quarter", "year")]
    return orders.select("o_orderkey", *units, dialect.concat(F.col("o_orderstatus"), F.lit(None).cast("string"), F.col("o_orderpriority")).alias("c"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streams.windowed_counts(_table(spark, sf_dir, "events"), "1 day")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "cnt", F.round("total", 4).alias("total"))


def unquoted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(spark=spark).sql(f"SELECT n_name, r_name FROM {sf_dir}/nation.parquet JOIN {sf_dir}/region.parquet ON n_regionkey = r_regionkey").df


def bound_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(f"{sf_dir}/orders.parquet#parquet", spark).sql("SELECT o_orderstatus, COUNT(*) AS n WHERE o_totalprice > 1000 GROUP BY o_orderstatus").df


# sources: a table is written in a format and read through the engine


def _written_csv(df: DataFrame, place: str) -> str:
    df.write.option("header", "true").csv(f"{place}/csv")
    return f"{place}/csv#csv"


def _written_jsonl(df: DataFrame, place: str) -> str:
    df.write.json(f"{place}/jsonl")
    return f"{place}/jsonl#jsonl"


def _text_file(df: DataFrame, place: str, suffix: str, text: str) -> str:
    """One file, written by Spark so that any executor can read it."""
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{place}/{suffix}")
    return f"{place}/{suffix}"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _written_json(df: DataFrame, place: str) -> str:
    return _text_file(df, place, "json", json.dumps({"status": "ok", "data": {"tables": [{"rows": _rows(df)}]}})) + "#json:data.tables[0].rows"


def _written_xml(df: DataFrame, place: str) -> str:
    names = df.columns
    items = "".join(f'<item {names[0]}="{r[names[0]]}"><more>' + "".join(f"<{c}>{r[c]}</{c}>" for c in names[1:]) + "</more></item>" for r in _rows(df))
    return _text_file(df, place, "xml", f"<all>{items}</all>") + "#xml:item"


def _written_html(df: DataFrame, place: str) -> str:
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r.values()) + "</tr>" for r in _rows(df))
    return _text_file(df, place, "html", f"<html><table><tr><th>other</th></tr><tr><td>1</td></tr></table><table><tr>{head}</tr>{body}</table></html>") + "#html:1"


def _written_markdown(df: DataFrame, place: str) -> str:
    return _text_file(df, place, "markdown", "# Title\n\n" + sinks.as_markdown(_rows(df)) + "\n") + "#markdown:-1"


def _round_trip(write: Callable[[DataFrame, str], str], table: str, select: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = write(_table(spark, sf_dir, table), _folder(spark))
        return Query(spark=spark).sql(f"SELECT {select} FROM '{source}'").df

    return run


def join_cross_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    nation = _written_csv(_table(spark, sf_dir, "nation"), place)
    region = _written_jsonl(_table(spark, sf_dir, "region"), place)
    return Query(spark=spark).sql(f"SELECT n_name, r_name FROM '{nation}' n LEFT JOIN '{region}' r ON n.n_regionkey = r.r_regionkey").df


def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _written_csv(_table(spark, sf_dir, "nation"), _folder(spark)).removesuffix("#csv")
    sql = f"SELECT n_name, r_name FROM read_csv('{nation}', header = true) n JOIN read_parquet('{sf_dir}/region.parquet') AS r ON n.n_regionkey = r.r_regionkey"
    return Query(spark=spark).sql(sql).df


def src_csv_odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that fit no type of the rows before them: fractions among whole numbers, texts among numbers."""
    odd = "o_orderkey", "CASE WHEN o_orderkey % 997 = 3 THEN '7.5' ELSE CAST(o_custkey AS STRING) END AS f", "CASE WHEN o_orderkey % 991 = 5 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS t"
    source = _written_csv(_table(spark, sf_dir, "orders").selectExpr(*odd), _folder(spark))
    return Query(spark=spark).sql(f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, f, t FROM '{source}'").df


def src_json_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under a key that is looked for, and those of all of a list's entries."""
    place = _folder(spark)
    rows = _rows(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    plain = _text_file(spark.range(1), place, "plain", json.dumps({"status": "ok", "records": rows}))
    nested = _text_file(spark.range(1), place, "nested", json.dumps({"pages": [{"rows": rows[:9]}, {"rows": rows[9:]}, {"other": 1}]}))
    read = "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM '{}'"
    return Query(spark=spark).sql(read.format(f"{plain}#json") + " UNION ALL " + read.format(f"{nested}#json:pages[].rows")).df


def src_parquet_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    for codec in CODECS:
        _table(spark, sf_dir, "part").select("p_partkey", "p_name").write.option("compression", codec).parquet(f"{place}/{codec}")
    return Query(spark=spark).sql(" UNION ALL ".join(f"SELECT p_partkey, p_name, '{c}' AS codec FROM '{place}/{c}#parquet'" for c in CODECS)).df


def src_parquet_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year"))
    orders.write.partitionBy("o_orderstatus", "year").parquet(f"{place}/orders")
    return Query(spark=spark).sql(f"SELECT o_orderkey, o_totalprice, o_orderstatus, year FROM '{place}/orders/o_orderstatus=F#parquet' WHERE year >= 1994").df


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    for kind in ("csv", "json", "parquet"):
        sinks.write(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), f"{place}/{kind}", kind)
    read = "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(p_size AS INTEGER) AS p_size FROM '{}'"
    return Query(spark=spark).sql(" UNION ALL ".join(read.format(f"{place}/{kind}#{'jsonl' if kind == 'json' else kind}") for kind in ("csv", "json", "parquet"))).df


CODECS = ("none", "snappy", "gzip", "zstd", "lz4")
NATION = "CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey"
NATION_XML = "CAST(`@n_nationkey` AS INTEGER) AS n_nationkey, `more.n_name` AS n_name, CAST(`more.n_regionkey` AS INTEGER) AS n_regionkey"
ORDERS = "CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice, STRFTIME(o_orderdate, '%Y-%m-%d') AS day"

FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "op_filter": (op_filter, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'A' AND l_linestatus <> 'x'"),
    "op_filter_type_mismatch": (op_filter_type_mismatch, 'SELECT COUNT(*) AS "count_*" FROM part WHERE p_size > 25'),
    "op_group_by": (
        op_group_by,
        'SELECT p_brand, COUNT(*) AS "count_*", SUM(p_size)::BIGINT AS sum_p_size, AVG(p_size) AS mean, MIN(p_name) AS min_p_name, MAX(p_retailprice) AS max_p_retailprice FROM part GROUP BY p_brand',
    ),
    "op_order_limit": (op_order_limit, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15"),
    "op_join": (op_join, "SELECT n_nationkey, n.n_name, n_regionkey, r_regionkey, r_name AS right_n_name FROM nation n LEFT JOIN region ON n_regionkey = r_regionkey"),
    "op_page": (op_page, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100"),
    "result_filter_contains": (
        result_filter_contains,
        "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_partkey::VARCHAR) LIKE '%steel%' OR lower(p_name) LIKE '%steel%' OR lower(p_type) LIKE '%steel%'",
    ),
    "result_filter_regex": (result_filter_regex, "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?i)^brand#[12]')"),
    "result_filter_between": (result_filter_between, "SELECT p_partkey, p_size, p_type FROM part WHERE p_size BETWEEN 10 AND 20 AND lower(p_type) LIKE 'p%'"),
    "json_text_field": (json_text_field, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "dialect_functions": (
        dialect_functions,
        "SELECT o_orderkey, "
        + ", ".join(f"date_diff('{u}', DATE '1993-05-20', o_orderdate::DATE) AS \"{u}\"" for u in ("day", "week", "month", "quarter", "year"))
        + ", concat(o_orderstatus, NULL, o_orderpriority) AS c FROM orders",
    ),
    "stream_windows": (
        stream_windows,
        "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS cnt, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2",
    ),
    "unquoted_path": (unquoted_path, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "bound_source": (bound_source, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus"),
    "join_cross_format": (join_cross_format, "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "table_functions": (table_functions, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "src_csv_odd_cells": (
        src_csv_odd_cells,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 3 THEN 7.5 ELSE o_custkey END::DOUBLE AS f, CASE WHEN o_orderkey % 991 = 5 THEN 'n/a' ELSE o_custkey::VARCHAR END AS t FROM orders",
    ),
    "src_json_found": (src_json_found, "SELECT n_nationkey, n_name FROM nation, range(2)"),
    "src_parquet_codecs": (src_parquet_codecs, f"SELECT p_partkey, p_name, codec FROM part, (SELECT unnest({list(CODECS)}) AS codec) t"),
    "src_parquet_partitions": (
        src_parquet_partitions,
        "SELECT o_orderkey, o_totalprice, o_orderstatus, year(o_orderdate)::INTEGER AS year FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1994",
    ),
    "sink_roundtrip": (sink_roundtrip, "SELECT p_partkey, p_name, p_size FROM part, range(3)"),
    "src_csv_roundtrip": (
        _round_trip(_written_csv, "orders", ORDERS),
        "SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    ),
    "src_jsonl_roundtrip": (_round_trip(_written_jsonl, "nation", NATION), "SELECT * FROM nation"),
    "src_json_roundtrip": (_round_trip(_written_json, "nation", NATION), "SELECT * FROM nation"),
    "src_xml_roundtrip": (_round_trip(_written_xml, "nation", NATION_XML), "SELECT * FROM nation"),
    "src_html_roundtrip": (_round_trip(_written_html, "nation", NATION), "SELECT * FROM nation"),
    "src_markdown_roundtrip": (_round_trip(_written_markdown, "nation", NATION), "SELECT * FROM nation"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, FLAGSHIP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sql_query(sql) for name, sql in SQL.items()} | {name: run for name, (run, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    plain = {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in SQL.items()}
    return plain | ORACLE_ONLY | {name: sql for name, (_, sql) in FUNCTIONS.items()}
