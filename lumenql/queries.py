"""The engine's registered queries: dialect SQL over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .database import Database

KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(spark: SparkSession, sf_dir: str, sql: str = "", extended: bool = False) -> Database:
    """The driver's tables, those that sql names (all without it)."""
    db = Database(spark, extended)
    for t in TABLES:
        if not sql or t in sql.lower():
            db.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), KEYS.get(t, []))
    return db


def _query(sql: str, params: dict | None = None, extended: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return database(spark, sf_dir, sql, extended).query(sql, params)

    return run


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str, oracle: str | None = None, params: dict | None = None, extended: bool = False, same: bool = False) -> None:
    """Registers a query; same: DuckDB runs the dialect's text as it is."""
    QUERIES[name] = _query(sql, params, extended)
    if oracle or same:
        ORACLES[name] = oracle or sql


add(
    "flagship",
    "SELECT n.n_name AS nation, COUNT(*) AS line_count, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey "
    "JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderdate >= @since GROUP BY n.n_name HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 10",
    "SELECT n.n_name AS nation, COUNT(*) AS line_count, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey "
    "JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n.n_name HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 10",
    {"since": __import__("datetime").datetime(1995, 1, 1)},
)
# scan, project, filter
add("scan_filter", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02", same=True)
add("star_except", "SELECT * EXCEPT (o_orderdate, o_totalprice) FROM orders", "SELECT * EXCLUDE (o_orderdate, o_totalprice) FROM orders")
add("star_replace", "SELECT * REPLACE (UPPER(n_name) AS n_name) FROM nation", same=True)
add("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", same=True)
add("between_in_like", "SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 10 AND 500 AND p_partkey NOT IN (11, 12) AND p_name LIKE '%a%'", same=True)
add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, IF(o_orderstatus = 'F', 1, 0) AS done FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(IF(o_orderstatus = 'F', 1, 0) AS BIGINT) AS done FROM orders")
add("param_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > @least AND o_orderstatus = @status", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'", {"least": 150000, "status": "O"})
# joins
add("join_inner", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", same=True)
add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", same=True)
add("join_right", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_suppkey < 20", same=True)
add("join_full", "SELECT a.c_custkey AS x, b.s_suppkey AS y FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey + 5", same=True)
add("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", same=True)
add("join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey", same=True)
add("join_using", "SELECT o_custkey, a.x, b.y FROM (SELECT o_custkey, COUNT(*) AS x FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, MAX(o_orderkey) AS y FROM orders GROUP BY o_custkey) b USING (o_custkey)", same=True)
add("join_theta", "SELECT s.s_suppkey, COUNT(*) AS n FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey GROUP BY s.s_suppkey", same=True)
add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", same=True)
add("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", same=True)
add("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", same=True)
add("not_in_nulls", "SELECT COUNT(*) AS n, COUNTIF(n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 7) FROM supplier)) AS m FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(n_regionkey, 9) FROM nation)", "SELECT COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 7) FROM supplier)) AS BIGINT) AS m FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(n_regionkey, 9) FROM nation)")
add("join_unnest", "SELECT e.vec_id, i, x FROM embeddings e CROSS JOIN UNNEST(e.embedding) AS x WITH OFFSET AS i", "SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
# aggregates
add("agg_global", "SELECT COUNT(*) AS n, SUM(l_orderkey) AS s, MIN(l_partkey) AS lo, MAX(l_partkey) AS hi, ROUND(AVG(l_quantity), 4) AS a FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s, MIN(l_partkey) AS lo, MAX(l_partkey) AS hi, ROUND(AVG(l_quantity), 4) AS a FROM lineitem")
add("agg_group", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus", same=True)
add("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000", same=True)
add("agg_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
add("countif", "SELECT o_orderstatus, COUNTIF(o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(COUNT(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
add("logical_and_or", "SELECT o_custkey, LOGICAL_AND(o_totalprice > 1000) AS a, LOGICAL_OR(o_totalprice > 200000) AS b FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 200000) AS b FROM orders GROUP BY o_custkey")
add("bit_aggs", "SELECT n_regionkey, BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
add("stddev_var", "SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS s, ROUND(VAR_SAMP(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag", same=True)
add("string_agg_ordered", "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC LIMIT 3) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name DESC)[1:3], '|') AS names FROM nation GROUP BY n_regionkey")
add("array_agg_nulls", "SELECT n_regionkey, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 3))) AS n, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 3) IGNORE NULLS)) AS m FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, COUNT(*) AS n, COUNT(NULLIF(n_nationkey, 3)) AS m FROM nation GROUP BY n_regionkey")
add("array_concat_agg", "SELECT n_regionkey, ARRAY_LENGTH(ARRAY_CONCAT_AGG([n_nationkey, 1])) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(2 * COUNT(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
add("any_value_having_max", "SELECT n_regionkey, ANY_VALUE(n_name HAVING MAX n_nationkey) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n FROM nation GROUP BY n_regionkey")
add("sum_having_min", "SELECT o_orderstatus, SUM(o_orderkey HAVING MIN o_custkey) AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_orderkey) FILTER (WHERE o_custkey = m) AS BIGINT) AS s, COUNT(*) AS n FROM (SELECT *, MIN(o_custkey) OVER (PARTITION BY o_orderstatus) AS m FROM orders) GROUP BY o_orderstatus")
add("group_by_alias_ordinal", "SELECT UPPER(o_orderstatus) AS st, MOD(o_custkey, 3) AS k, COUNT(*) AS n FROM orders GROUP BY st, 2", "SELECT UPPER(o_orderstatus) AS st, o_custkey % 3 AS k, COUNT(*) AS n FROM orders GROUP BY ALL")
# windows
add("qualify_is_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE TRUE QUALIFY IS_FIRST(3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
add("is_first", "SELECT n_nationkey, IS_FIRST(2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f FROM nation", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 2 AS f FROM nation")
add("ext_windows", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, LAG(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lg, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM orders", extended=True, same=True)
# order, limit, set operations
add("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20", same=True)
add("order_nulls", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r, n_nationkey LIMIT 7", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r NULLS FIRST, n_nationkey LIMIT 7")
add("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5", same=True)
add("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", same=True)
add("union_distinct", "SELECT n_regionkey AS k FROM nation UNION DISTINCT SELECT r_regionkey FROM region", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
add("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT MOD(n_nationkey, 3) FROM nation", "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation INTERSECT ALL SELECT n_nationkey % 3 FROM nation")
add("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT DISTINCT SELECT r_regionkey FROM region", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
add("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", same=True)
# subqueries and CTEs
add("scalar_sub", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", same=True)
add("correlated_scalar", "SELECT c.c_custkey, (SELECT MAX(o.o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c", same=True)
add("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", same=True)
add("array_subquery", "SELECT r_regionkey, ARRAY_TO_STRING(ARRAY(SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name), ',') AS names FROM region r", "SELECT r_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS names FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r_regionkey")
add("cte_multi", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 10) SELECT c.c_name FROM customer c JOIN b ON c.c_custkey = b.k", same=True)
add("recursive_numbers", "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t", "WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS n UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")
add("recursive_hierarchy", "WITH RECURSIVE h AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, h.depth + 1 FROM nation n JOIN h ON DIV(n.n_nationkey - 1, 2) = h.k AND n.n_nationkey > 0) SELECT k, depth FROM h", "WITH RECURSIVE h AS (SELECT n_nationkey AS k, CAST(0 AS BIGINT) AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, h.depth + 1 FROM nation n JOIN h ON (n.n_nationkey - 1) // 2 = h.k AND n.n_nationkey > 0) SELECT k, depth FROM h")
# arrays and structs
add("unnest_offset", "SELECT x, i FROM UNNEST([30, 10, 20]) AS x WITH OFFSET AS i", "SELECT * FROM (VALUES (CAST(30 AS BIGINT), CAST(0 AS BIGINT)), (10, 1), (20, 2)) v(x, i)")
add("array_funcs", "SELECT vec_id, ARRAY_LENGTH(embedding) AS n, ROUND(CAST(ARRAY_FIRST(embedding) AS FLOAT64), 5) AS f, ROUND(CAST(ARRAY_MAX(embedding) AS FLOAT64), 5) AS m FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, ROUND(CAST(embedding[1] AS DOUBLE), 5) AS f, ROUND(CAST(list_max(embedding) AS DOUBLE), 5) AS m FROM embeddings")
add("generate_array", "SELECT n_nationkey, ARRAY_LENGTH(GENERATE_ARRAY(1, n_nationkey)) AS n FROM nation", "SELECT n_nationkey, CAST(len(range(1, n_nationkey + 1)) AS BIGINT) AS n FROM nation")
add("generate_date_array", "SELECT d FROM UNNEST(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 WEEK)) AS d", "SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 7 DAY)) AS d)")
add("struct_fields", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, STRUCT(n_name AS a, n_regionkey + 1 AS b) AS s FROM nation)", "SELECT n_nationkey, n_name AS a, CAST(n_regionkey + 1 AS BIGINT) AS b FROM nation")
add("select_as_struct", "SELECT x.k AS k, x.n AS n FROM UNNEST(ARRAY(SELECT AS STRUCT n_nationkey AS k, n_name AS n FROM nation)) AS x", "SELECT n_nationkey AS k, n_name AS n FROM nation")
add("array_subscript", "SELECT vec_id, ROUND(CAST(embedding[OFFSET(1)] AS FLOAT64), 5) AS a, ROUND(CAST(embedding[SAFE_ORDINAL(64)] AS FLOAT64), 5) AS b FROM embeddings", "SELECT vec_id, ROUND(CAST(embedding[2] AS DOUBLE), 5) AS a, ROUND(CAST(embedding[64] AS DOUBLE), 5) AS b FROM embeddings")
# strings
add("string_core", "SELECT c_custkey, LENGTH(c_name) AS n, UPPER(c_mktsegment) AS u, STRPOS(c_name, '#') AS p, REVERSE(c_name) AS r, STARTS_WITH(c_name, 'Cust') AS s FROM customer", "SELECT c_custkey, length(c_name) AS n, upper(c_mktsegment) AS u, strpos(c_name, '#') AS p, reverse(c_name) AS r, starts_with(c_name, 'Cust') AS s FROM customer")
add("substr_edges", "SELECT n_nationkey, SUBSTR(n_name, -3) AS a, SUBSTR(n_name, 2, 3) AS b, SUBSTR(n_name, -100, 2) AS c FROM nation", "SELECT n_nationkey, CASE WHEN length(n_name) < 3 THEN n_name ELSE right(n_name, 3) END AS a, substr(n_name, 2, 3) AS b, substr(n_name, 1, 2) AS c FROM nation")
add("regexp_suite", "SELECT page_id, REGEXP_CONTAINS(url, r'^https') AS s, REGEXP_EXTRACT(url, r'/(\\d+)') AS d, REGEXP_REPLACE(url, r'\\d+', '#') AS r FROM pages", "SELECT page_id, regexp_matches(url, '^https') AS s, nullif(regexp_extract(url, '/(\\d+)', 1), '') AS d, regexp_replace(url, '\\d+', '#', 'g') AS r FROM pages")
add("split_pad_repeat", "SELECT n_nationkey, LPAD(n_name, 12, '*') AS l, RPAD(n_name, 4) AS r, REPEAT('ab', MOD(n_nationkey, 3)) AS x, ARRAY_LENGTH(SPLIT(n_name, 'A')) AS k FROM nation", "SELECT n_nationkey, CASE WHEN length(n_name) > 12 THEN left(n_name, 12) ELSE lpad(n_name, 12, '*') END AS l, left(n_name || '    ', 4) AS r, repeat('ab', n_nationkey % 3) AS x, CAST(len(string_split(n_name, 'A')) AS BIGINT) AS k FROM nation")
add("hash_suite", "SELECT doc_id, TO_HEX(MD5(text)) AS m, TO_HEX(SHA256(text)) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
add("concat_format", "SELECT o_orderkey, CONCAT(o_orderstatus, '-', CAST(o_custkey AS STRING)) AS c, FORMAT('%05d', o_custkey) AS f FROM orders", "SELECT o_orderkey, o_orderstatus || '-' || CAST(o_custkey AS VARCHAR) AS c, CASE WHEN length(CAST(o_custkey AS VARCHAR)) >= 5 THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS f FROM orders")
# dates
add("extract_parts", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(QUARTER FROM o_orderdate) AS q, EXTRACT(DAYOFWEEK FROM o_orderdate) AS d, EXTRACT(ISOWEEK FROM o_orderdate) AS w, EXTRACT(DAYOFYEAR FROM o_orderdate) AS j FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS d, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS j FROM orders")
add("date_trunc_parts", "SELECT o_orderkey, DATE_TRUNC(DATE(o_orderdate), MONTH) AS m, DATE_TRUNC(DATE(o_orderdate), ISOWEEK) AS w, DATE_TRUNC(DATE(o_orderdate), YEAR) AS y FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(date_trunc('year', o_orderdate) AS DATE) AS y FROM orders")
add("date_diff_boundaries", "SELECT o_orderkey, DATE_DIFF(DATE '1998-12-31', DATE(o_orderdate), DAY) AS d, DATE_DIFF(DATE '1998-12-31', DATE(o_orderdate), MONTH) AS m, DATE_DIFF(DATE '1998-12-31', DATE(o_orderdate), YEAR) AS y FROM orders", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS d, date_diff('month', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS m, date_diff('year', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS y FROM orders")
add("date_arithmetic", "SELECT o_orderkey, DATE_ADD(DATE(o_orderdate), INTERVAL 1 MONTH) AS a, DATE_SUB(DATE(o_orderdate), INTERVAL 10 DAY) AS b, UNIX_DATE(DATE(o_orderdate)) AS u FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS b, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS u FROM orders")
add("format_date", "SELECT o_orderkey, FORMAT_DATE('%Y/%m/%d', DATE(o_orderdate)) AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders")
# mathematics
add("math_round", "SELECT l_orderkey, l_linenumber, FLOOR(l_extendedprice) AS f, CEIL(l_extendedprice) AS c, MOD(l_partkey, 7) AS m, DIV(l_partkey, 7) AS d, SIGN(l_discount - 0.05) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, l_partkey % 7 AS m, l_partkey // 7 AS d, CAST(sign(l_discount - 0.05) AS DOUBLE) AS s FROM lineitem")
add("safe_arith", "SELECT n_nationkey, SAFE_DIVIDE(10, n_nationkey - 5) AS d, SAFE_ADD(n_nationkey, 9223372036854775800) AS a, GREATEST(n_nationkey, n_regionkey) AS g, LEAST(n_nationkey, NULL) AS l FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN NULL ELSE 10.0::DOUBLE / (n_nationkey - 5) END AS d, CASE WHEN n_nationkey > 7 THEN NULL ELSE CAST(n_nationkey + 9223372036854775800 AS BIGINT) END AS a, greatest(n_nationkey, n_regionkey) AS g, CAST(NULL AS BIGINT) AS l FROM nation")
add("trig_suite", "SELECT n_nationkey, ROUND(SIN(n_nationkey), 9) AS s, ROUND(ATAN2(n_nationkey, 3), 9) AS a, ROUND(SQRT(n_nationkey), 9) AS q, ROUND(LOG(n_nationkey + 1, 2), 9) AS l, ROUND(POW(n_nationkey, 2), 3) AS p FROM nation", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(atan2(n_nationkey, 3), 9) AS a, round(sqrt(n_nationkey), 9) AS q, round(ln(n_nationkey + 1) / ln(2), 9) AS l, round(pow(n_nationkey, 2), 3) AS p FROM nation")
# JSON, vectors, search, net
add("json_value", "SELECT n_nationkey, JSON_VALUE(j, '$.name') AS v, JSON_QUERY(j, '$.tags') AS t, JSON_TYPE(j) AS k FROM (SELECT n_nationkey, JSON_OBJECT('name', n_name, 'tags', JSON_ARRAY(n_regionkey, 'x')) AS j FROM nation)", "SELECT n_nationkey, n_name AS v, '[' || n_regionkey || ',\"x\"]' AS t, 'object' AS k FROM nation")
add("cosine_topk", "SELECT a.vec_id, ROUND(COSINE_DISTANCE(a.embedding, b.embedding), 5) AS d FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY d, a.vec_id LIMIT 10", "SELECT a.vec_id, ROUND(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS d FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY d, a.vec_id LIMIT 10")
add("euclidean_dot", "SELECT a.vec_id, ROUND(EUCLIDEAN_DISTANCE(a.embedding, b.embedding), 4) AS e, ROUND(DOT_PRODUCT(a.embedding, b.embedding), 4) AS p FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 1) b", "SELECT a.vec_id, ROUND(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS e, ROUND(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS p FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 1) b")
add("search_words", "SELECT doc_id FROM documents WHERE SEARCH(TOKENIZE_FULLTEXT(text), 'licensed apache')", "SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s#]', '', 'g')), '\\s+'), 'licensed') AND list_contains(string_split_regex(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s#]', '', 'g')), '\\s+'), 'apache')")
add("search_phrase", "SELECT doc_id FROM documents WHERE SEARCH(TOKENIZE_FULLTEXT(text), '\"mit license\"')", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(string_split_regex(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s#]', '', 'g')), '\\s+'), lambda x: x <> ''), ' ') || ' ', ' mit license ')")
add("net_host", "SELECT page_id, NET.HOST(url) AS h, NET.REG_DOMAIN(NET.HOST(url)) AS d FROM pages", "SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS h, regexp_extract(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '([^.]+\\.[^.]+)$', 1) AS d FROM pages")
add("json_props", "SELECT event_id, JSON_VALUE(PARSE_JSON(props), '$.k') AS v, CAST(JSON_VALUE(props, '$.k') AS INT64) AS n, ARRAY_LENGTH(JSON_KEYS(PARSE_JSON(props))) AS m FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, CAST(len(json_keys(props)) AS BIGINT) AS m FROM events")
add("timestamp_parts", "SELECT event_id, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MICROSECOND FROM ts) AS u, UNIX_SECONDS(ts) AS s, TIMESTAMP_DIFF(ts, DATETIME '2024-01-01 00:00:00', MINUTE) AS m FROM events", "SELECT event_id, hour(ts) AS h, CAST(epoch_us(ts) % 1000000 AS BIGINT) AS u, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 60000000 AS BIGINT) AS m FROM events")
add("hourly_events", "SELECT FORMAT_TIMESTAMP('%Y-%m-%d %H', ts) AS hour, event_type, COUNT(*) AS n, COUNTIF(value > 10) AS big FROM events GROUP BY hour, event_type", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE value > 10) AS BIGINT) AS big FROM events GROUP BY ALL")
add("conversation_turns", "SELECT conv_id, STRING_AGG(role, '>' ORDER BY turn) AS roles, MAX(LENGTH(text)) AS longest, COUNT(DISTINCT role) AS k FROM conversations GROUP BY conv_id", "SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS roles, MAX(length(text)) AS longest, COUNT(DISTINCT role) AS k FROM conversations GROUP BY conv_id")
add("ext_approx_distinct", "SELECT o_orderstatus, ABS(APPROX_COUNT_DISTINCT(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.15 * COUNT(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus")
add("tablesample_bounds", "SELECT n BETWEEN 0.05 * total AND 0.15 * total AS ok FROM (SELECT COUNT(*) AS n FROM lineitem TABLESAMPLE BERNOULLI (10 PERCENT)) a CROSS JOIN (SELECT COUNT(*) AS total FROM lineitem) b", "SELECT COUNT(*) > 0 AS ok FROM lineitem")
add("reservoir_k", "SELECT COUNT(*) AS n FROM orders TABLESAMPLE RESERVOIR (100 ROWS)", "SELECT CAST(100 AS BIGINT) AS n")


def _changes(*statements: str, then: str):
    """A query over tables that are copied into a database, where the statements run first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, " ".join(statements) + then)
        for s in statements[:-1]:
            db.execute(s)
        out = db.execute(statements[-1]) if statements else None
        return out if isinstance(out, DataFrame) and not then else db.query(then)

    return run


def change(name: str, *statements: str, then: str = "", oracle: str) -> None:
    QUERIES[name] = _changes(*statements, then=then)
    ORACLES[name] = oracle


change("update_where", "UPDATE nation SET n_name = CONCAT(n_name, '!'), n_regionkey = n_regionkey + 10 WHERE n_nationkey < 5", then="SELECT n_nationkey, n_name, n_regionkey FROM nation", oracle="SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name || '!' ELSE n_name END AS n_name, CAST(CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation")
change("upsert_merge", "INSERT OR UPDATE INTO region (r_regionkey, r_name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 8", then="SELECT r_regionkey, r_name FROM region", oracle="SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 8")
change("insert_on_conflict", "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'x'), (9, 'y') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = CONCAT(region.r_name, EXCLUDED.r_name) WHERE region.r_regionkey > 0", then="SELECT r_regionkey, r_name FROM region", oracle="SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || 'x' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'y'")
change("then_return", "DELETE FROM nation WHERE n_regionkey = 2 THEN RETURN WITH ACTION AS act n_nationkey, UPPER(n_name) AS u", oracle="SELECT n_nationkey, upper(n_name) AS u, 'DELETE' AS act FROM nation WHERE n_regionkey = 2")
change("delete_where", "DELETE FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", then="SELECT c_custkey FROM customer", oracle="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
change("information_schema_columns", then="SELECT TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME IN ('nation', 'region')", oracle="SELECT * FROM (VALUES ('nation', 'n_nationkey', CAST(1 AS BIGINT)), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3), ('region', 'r_regionkey', 1), ('region', 'r_name', 2)) v(\"TABLE_NAME\", \"COLUMN_NAME\", \"ORDINAL_POSITION\")")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute windows of events, the batch form of the streaming extension."""
    from pyspark.sql import functions as F

    from .streaming.windows import windowed

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    d = windowed(events, "ts", "10 minutes", keys=("event_type",), n=F.count("*"), users=F.countDistinct("user_id"))
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "users")


QUERIES["event_windows"] = event_windows
ORACLES["event_windows"] = "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events GROUP BY ALL"


from . import suites, suites_data  # noqa: E402, F401  they add to QUERIES and ORACLES
