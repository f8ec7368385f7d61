"""Registered queries on scalar functions, casts, predicates and clauses, each with its DuckDB counterpart."""

from __future__ import annotations

from .queries import add

LA = "America/Los_Angeles"


def suite(name: str, source: str, *items: tuple[str, str, str], key: str = "", oracle_source: str = "", extended: bool = False) -> None:
    """Registers one query of many expressions: items are (column, the dialect's expression, DuckDB's); key columns come first."""
    head = [(k.strip(), k.strip(), k.strip()) for k in key.split(",") if k.strip()]
    left, right = (", ".join(f"{e[i]} AS {e[0]}" for e in (*head, *items)) for i in (1, 2))
    add(name, f"SELECT {left} FROM {source}" if source else f"SELECT {left}", f"SELECT {right} FROM {oracle_source or source}" if source else f"SELECT {right}", extended=extended)


def same(column: str, expression: str) -> tuple[str, str, str]:
    return column, expression, expression


# casts
suite(
    "cast_to_int64", "lineitem",
    ("from_float", "CAST(l_extendedprice AS INT64)", "CAST(CASE WHEN l_extendedprice >= 0 THEN floor(l_extendedprice + 0.5) ELSE ceil(l_extendedprice - 0.5) END AS BIGINT)"),
    ("half_away", "CAST(l_linenumber - 3.5 AS INT64)", "CAST(CASE WHEN l_linenumber > 3 THEN l_linenumber - 3 ELSE l_linenumber - 4 END AS BIGINT)"),
    ("from_numeric", "CAST(CAST(l_discount AS NUMERIC) * 100 AS INT64)", "CAST(round(CAST(l_discount AS DECIMAL(38,9)) * 100) AS BIGINT)"),
    ("from_string", "CAST(CAST(l_partkey AS STRING) AS INT64)", "CAST(l_partkey AS BIGINT)"),
    ("from_hex", "CAST(CONCAT('0x', TO_HEX(CODE_POINTS_TO_BYTES([l_linenumber, 16]))) AS INT64)", "CAST(l_linenumber * 256 + 16 AS BIGINT)"),
    ("bad", "SAFE_CAST(CONCAT('x', l_linestatus) AS INT64)", "CAST(NULL AS BIGINT)"),
    ("from_bool", "CAST(l_quantity > 25 AS INT64)", "CAST(l_quantity > 25 AS BIGINT)"),
    key="l_orderkey, l_linenumber",
)
suite(
    "cast_to_float64", "orders",
    ("from_int", "CAST(o_custkey AS FLOAT64) / 4", "CAST(o_custkey AS DOUBLE) / 4"),
    ("from_string", "CAST(CONCAT(CAST(o_custkey AS STRING), '.25') AS FLOAT64)", "CAST(o_custkey AS DOUBLE) + 0.25"),
    ("words", "IS_INF(CAST(IF(o_orderstatus = 'F', '-INF', 'infinity') AS FLOAT64))", "true"),
    ("nan", "IS_NAN(CAST(IF(o_orderstatus = 'F', 'NaN', '1') AS FLOAT64))", "o_orderstatus = 'F'"),
    ("bad", "SAFE_CAST(o_orderpriority AS FLOAT64)", "CAST(NULL AS DOUBLE)"),
    key="o_orderkey",
)
suite(
    "cast_to_string", "orders",
    ("from_bool", "CAST(o_totalprice > 150000 AS STRING)", "CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END"),
    ("whole", "CAST(CAST(o_custkey AS FLOAT64) AS STRING)", "CAST(o_custkey AS VARCHAR)"),
    ("half", "CAST(o_custkey + 0.5 AS STRING)", "CAST(o_custkey AS VARCHAR) || '.5'"),
    ("infinite", "CAST(IEEE_DIVIDE(IF(o_orderstatus = 'F', 1, -1), 0) AS STRING)", "CASE WHEN o_orderstatus = 'F' THEN 'inf' ELSE '-inf' END"),
    ("from_date", "CAST(DATE(o_orderdate) AS STRING)", "strftime(o_orderdate, '%Y-%m-%d')"),
    ("from_numeric", "CAST(CAST(o_custkey AS NUMERIC) / 4 AS STRING)", "CASE o_custkey % 4 WHEN 0 THEN CAST(o_custkey // 4 AS VARCHAR) WHEN 1 THEN CAST(o_custkey // 4 AS VARCHAR) || '.25' WHEN 2 THEN CAST(o_custkey // 4 AS VARCHAR) || '.5' ELSE CAST(o_custkey // 4 AS VARCHAR) || '.75' END"),
    key="o_orderkey",
)
suite(
    "cast_times", "events",
    ("winter", "CAST(TIMESTAMP_SECONDS(1704110400 + event_id * 60) AS STRING)", "strftime(TIMESTAMP '2024-01-01 04:00:00' + to_seconds(event_id * 60), '%Y-%m-%d %H:%M:%S') || '-08'"),
    ("winter_day", "CAST(TIMESTAMP_SECONDS(1704067200 + event_id * 60) AS DATE)", "CAST(TIMESTAMP '2023-12-31 16:00:00' + to_seconds(event_id * 60) AS DATE)"),
    ("summer_day", "UNIX_SECONDS(CAST(DATE_ADD(DATE '2024-06-01', INTERVAL MOD(event_id, 60) DAY) AS TIMESTAMP))", "CAST(1717225200 + (event_id % 60) * 86400 AS BIGINT)"),
    ("from_string", "CAST(CONCAT('2024-02-', LPAD(CAST(1 + MOD(event_id, 28) AS STRING), 2, '0')) AS DATE)", "CAST(DATE '2024-02-01' + CAST(event_id % 28 AS INTEGER) AS DATE)"),
    ("bad", "SAFE_CAST('2024-02-30' AS DATE)", "CAST(NULL AS DATE)"),
    key="event_id",
)
suite(
    "cast_bytes_json", "nation",
    ("bytes", "TO_HEX(CAST(n_name AS BYTES))", "lower(hex(n_name))"),
    ("back", "CAST(CAST(n_name AS BYTES) AS STRING)", "n_name"),
    ("numeric", "CAST(CAST(CONCAT(CAST(n_nationkey AS STRING), '.125') AS NUMERIC) * 8 AS INT64)", "CAST(n_nationkey * 8 + 1 AS BIGINT)"),
    ("json", "JSON_VALUE(CAST(CONCAT('{\"a\": ', CAST(n_nationkey AS STRING), '}') AS JSON), '$.a')", "CAST(n_nationkey AS VARCHAR)"),
    ("json_null", "JSON_TYPE(CAST('null' AS JSON))", "'null'"),
    ("uuid", "CAST(CAST('123e4567-e89b-12d3-a456-426614174000' AS UUID) AS STRING)", "'123e4567-e89b-12d3-a456-426614174000'"),
    ("arrays", "ARRAY_TO_STRING(CAST([n_name, 'x'] AS ARRAY<STRING>), '+')", "n_name || '+x'"),
    ("bool", "CAST(IF(n_regionkey = 1, 'TRUE', 'false') AS BOOL)", "n_regionkey = 1"),
    key="n_nationkey",
)
# predicates and operators
suite(
    "operators", "orders",
    ("remainder", "MOD(o_custkey, 7)", "o_custkey % 7"),
    ("minus", "-o_custkey", "-o_custkey"),
    ("is_null", "NULLIF(o_orderstatus, 'F') IS NULL", "o_orderstatus = 'F'"),
    ("not_null", "NULLIF(o_orderstatus, 'F') IS NOT NULL", "o_orderstatus <> 'F'"),
    ("is_true", "(NULLIF(o_orderstatus, 'F') = 'O') IS TRUE", "o_orderstatus = 'O'"),
    ("is_not_true", "(NULLIF(o_orderstatus, 'F') = 'O') IS NOT TRUE", "o_orderstatus <> 'O'"),
    ("is_false", "(NULLIF(o_orderstatus, 'F') = 'O') IS FALSE", "o_orderstatus NOT IN ('F', 'O')"),
    ("is_not_false", "(NULLIF(o_orderstatus, 'F') = 'O') IS NOT FALSE", "o_orderstatus IN ('F', 'O')"),
    ("in_array", "MOD(o_custkey, 5) IN UNNEST([1, 3])", "o_custkey % 5 IN (1, 3)"),
    ("not_in_array", "MOD(o_custkey, 5) NOT IN UNNEST([1, 3])", "o_custkey % 5 NOT IN (1, 3)"),
    ("across", "o_custkey > 700.5", "o_custkey > 700.5"),
    ("date_text", "DATE(o_orderdate) < '1995-06-17'", "o_orderdate < TIMESTAMP '1995-06-17'"),
    ("safe", "SAFE.LN(o_custkey - 700) IS NULL", "o_custkey <= 700"),
    ("safe_substr", "SAFE.SUBSTR(o_orderstatus, 1, IF(o_custkey > 700, -1, 1))", "CASE WHEN o_custkey > 700 THEN NULL ELSE o_orderstatus END"),
    key="o_orderkey",
)
add("named_argument", "SELECT n_nationkey, JSON_VALUE(TO_JSON(STRUCT(n_name AS a), stringify_wide_numbers => FALSE), '$.a') AS v FROM nation", "SELECT n_nationkey, n_name AS v FROM nation")
add("no_from", "SELECT 1 + 2 AS a, 'x' AS b, NULL IS NULL AS c, [1, 2][OFFSET(1)] AS d", "SELECT CAST(3 AS BIGINT) AS a, 'x' AS b, true AS c, CAST(2 AS BIGINT) AS d")
add("table_star", "SELECT r.*, n.n_name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey", same=True)
add("struct_star", "SELECT n_nationkey, s.* FROM (SELECT n_nationkey, STRUCT(n_name AS a, n_regionkey AS b) AS s FROM nation)", "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation")
add("hints", "@{USE_ADDITIONAL_PARALLELISM=TRUE} SELECT n.n_name, r.r_name FROM nation@{FORCE_INDEX=_BASE_TABLE} n JOIN@{JOIN_METHOD=HASH_JOIN} region r ON n.n_regionkey = r.r_regionkey", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("for_update", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 FOR UPDATE", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
add("nulls_order", "SELECT n_nationkey, k FROM (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation) ORDER BY k DESC, n_nationkey LIMIT 22", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 22")
add("mixed_sets", "(SELECT n_nationkey AS k FROM nation EXCEPT DISTINCT SELECT r_regionkey FROM region) UNION ALL (SELECT r_regionkey FROM region INTERSECT DISTINCT SELECT n_regionkey FROM nation)", "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region) UNION ALL (SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation)")
add("set_order_limit", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 9", same=True)
add("outer_unnest", "SELECT k, x FROM (SELECT n_nationkey AS k, GENERATE_ARRAY(1, MOD(n_nationkey, 4)) AS a FROM nation) t LEFT JOIN UNNEST(t.a) AS x", "SELECT n_nationkey AS k, x FROM nation LEFT JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS x) ON x <= n_nationkey % 4")
add("outer_unnest_on", "SELECT k, x FROM (SELECT n_nationkey AS k, GENERATE_ARRAY(1, MOD(n_nationkey, 4)) AS a FROM nation) t LEFT JOIN UNNEST(t.a) AS x ON x > 1", "SELECT n_nationkey AS k, x FROM nation LEFT JOIN (SELECT CAST(unnest([2, 3]) AS BIGINT) AS x) ON x <= n_nationkey % 4")
add("agg_of_nothing", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_totalprice) AS m, STRING_AGG(o_orderstatus) AS t FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MAX(o_totalprice) AS m, string_agg(o_orderstatus, ',') AS t FROM orders WHERE o_orderkey < 0")
add("not_in_with_nulls", "SELECT n_nationkey, n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region) AS f FROM nation", "SELECT n_nationkey, n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region) AS f FROM nation")
add("anti_rows", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", same=True)
add("array_agg_values", "SELECT n_regionkey, ARRAY_TO_STRING(ARRAY_AGG(NULLIF(n_name, 'CHINA') IGNORE NULLS ORDER BY n_name DESC LIMIT 4), '|') AS a, ARRAY_TO_STRING(ARRAY_CONCAT_AGG([n_name, 'x'] ORDER BY n_nationkey), ',') AS b FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name DESC) FILTER (WHERE n_name <> 'CHINA')[1:4], '|') AS a, array_to_string(flatten(list([n_name, 'x'] ORDER BY n_nationkey)), ',') AS b FROM nation GROUP BY n_regionkey")
add("bernoulli_share", "SELECT n BETWEEN 0.25 * total AND 0.35 * total AS near FROM (SELECT COUNT(*) AS n FROM lineitem TABLESAMPLE BERNOULLI (30 PERCENT)) a CROSS JOIN (SELECT COUNT(*) AS total FROM lineitem) b", "SELECT COUNT(*) > 0 AS near FROM lineitem")
add("min_max_nan", "SELECT n_regionkey, IS_NAN(MIN(x)) AS lo, IS_NAN(MAX(x)) AS hi, MIN(IF(IS_NAN(x), NULL, x)) AS least_ FROM (SELECT n_regionkey, IF(n_nationkey = 3, CAST('nan' AS FLOAT64), n_nationkey / 2) AS x FROM nation) GROUP BY n_regionkey", "SELECT n_regionkey, bool_or(n_nationkey = 3) AS lo, bool_or(n_nationkey = 3) AS hi, MIN(n_nationkey / 2) FILTER (WHERE n_nationkey <> 3) AS least_ FROM nation GROUP BY n_regionkey")
# conditional
suite(
    "conditional", "customer",
    ("coalesced", "COALESCE(NULLIF(c_mktsegment, 'BUILDING'), NULLIF(c_name, 'x'), 'none')", "coalesce(nullif(c_mktsegment, 'BUILDING'), c_name)"),
    ("ifnull_", "IFNULL(NULLIF(c_nationkey, 3), -1)", "coalesce(nullif(c_nationkey, 3), -1)"),
    ("if_", "IF(c_acctbal > 0, 'plus', 'minus')", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END"),
    ("nullif_", "NULLIF(c_nationkey, 3)", "nullif(c_nationkey, 3)"),
    ("error_", "IF(c_custkey >= 0, 'fine', ERROR('a key below zero'))", "'fine'"),
    key="c_custkey",
)
# strings
suite(
    "string_trims", "part",
    ("trimmed", "TRIM(CONCAT('  ', p_name, ' '))", "p_name"),
    ("trim_set", "TRIM(p_brand, 'B#1')", "trim(p_brand, 'B#1')"),
    ("left_trim", "LTRIM(p_brand, 'Br')", "ltrim(p_brand, 'Br')"),
    ("right_trim", "RTRIM(p_brand, '123')", "rtrim(p_brand, '123')"),
    ("ends", "ENDS_WITH(p_brand, '3')", "ends_with(p_brand, '3')"),
    ("starts", "STARTS_WITH(p_name, 'a')", "starts_with(p_name, 'a')"),
    ("replaced", "REPLACE(p_name, 'a', 'oo')", "replace(p_name, 'a', 'oo')"),
    ("lower_", "LCASE(p_brand)", "lower(p_brand)"),
    ("upper_", "UCASE(p_name)", "upper(p_name)"),
    ("chars", "CHAR_LENGTH(p_name) + CHARACTER_LENGTH(p_brand)", "length(p_name) + length(p_brand)"),
    ("part_", "SUBSTRING(p_name, 2, 4)", "substr(p_name, 2, 4)"),
    ("like_", "p_name LIKE '_a%'", "p_name LIKE '_a%'"),
    key="p_partkey",
)
suite(
    "string_bytes", "documents",
    ("bytes", "BYTE_LENGTH(text)", "CAST(strlen(text) AS BIGINT)"),
    ("octets", "OCTET_LENGTH(text)", "CAST(strlen(text) AS BIGINT)"),
    ("head", "TO_HEX(CAST(SUBSTR(text, 1, 12) AS BYTES))", "lower(hex(substr(text, 1, 12)))"),
    ("round_trip", "SAFE_CONVERT_BYTES_TO_STRING(FROM_HEX(TO_HEX(CAST(text AS BYTES)))) = text", "true"),
    ("base64", "TO_BASE64(CAST(SUBSTR(text, 1, 20) AS BYTES))", "to_base64(encode(substr(text, 1, 20)))"),
    ("base64_back", "CAST(FROM_BASE64(TO_BASE64(CAST(text AS BYTES))) AS STRING) = text", "true"),
    ("base32_back", "CAST(FROM_BASE32(TO_BASE32(CAST(SUBSTR(text, 1, 33) AS BYTES))) AS STRING)", "substr(text, 1, 33)"),
    ("points", "TO_CODE_POINTS(text)[SAFE_OFFSET(0)]", "CAST(ord(text) AS BIGINT)"),
    ("made", "CODE_POINTS_TO_STRING(TO_CODE_POINTS(SUBSTR(text, 1, 50)))", "substr(text, 1, 50)"),
    ("made_bytes", "TO_HEX(CODE_POINTS_TO_BYTES([MOD(doc_id, 256), 7]))", "lower(printf('%02x', doc_id % 256)) || '07'"),
    key="doc_id",
)
suite(
    "string_forms", "nation",
    ("nfd", "LENGTH(NORMALIZE(CONCAT(n_name, 'é'), NFD)) - LENGTH(n_name)", "CAST(2 AS BIGINT)"),
    ("nfc", "NORMALIZE(CONCAT(n_name, 'e\\u0301'), NFC)", "n_name || 'é'"),
    ("folded", "NORMALIZE_AND_CASEFOLD(CONCAT(n_name, 'É'))", "lower(n_name) || 'é'"),
    ("sound", "SOUNDEX(CONCAT('Rupert', REPEAT('h', MOD(n_nationkey, 3))))", "'R163'"),
    ("piece", "SPLIT_SUBSTR(CONCAT(n_name, '.b.', CAST(n_nationkey AS STRING)), '.', 2, 1)", "'b'"),
    ("last_piece", "SPLIT_SUBSTR(CONCAT(n_name, '.b.', CAST(n_nationkey AS STRING)), '.', -1)", "CAST(n_nationkey AS VARCHAR)"),
    ("all_found", "ARRAY_TO_STRING(REGEXP_EXTRACT_ALL(n_name, r'[AEIOU]'), '')", "array_to_string(regexp_extract_all(n_name, '[AEIOU]'), '')"),
    ("instr", "REGEXP_INSTR(n_name, r'[AEIOU]')", "CAST(CASE WHEN regexp_matches(n_name, '[AEIOU]') THEN length(regexp_extract(n_name, '^[^AEIOU]*')) + 1 ELSE 0 END AS BIGINT)"),
    ("uuid_shape", "REGEXP_CONTAINS(GENERATE_UUID(), r'^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$')", "true"),
    ("new_uuid", "LENGTH(CAST(NEW_UUID() AS STRING))", "CAST(36 AS BIGINT)"),
    key="n_nationkey",
)
add("uuid_distinct", "SELECT COUNT(DISTINCT u) = COUNT(*) AS every_one FROM (SELECT GENERATE_UUID() AS u FROM lineitem)", "SELECT COUNT(*) > 0 AS every_one FROM lineitem")
# mathematics
suite(
    "math_rounding", "lineitem",
    ("absolute", "ABS(l_linenumber - 4)", "abs(l_linenumber - 4)"),
    ("down", "FLOOR(l_extendedprice / 7)", "floor(l_extendedprice / 7)"),
    ("up", "CEILING(l_extendedprice / 7)", "ceil(l_extendedprice / 7)"),
    ("cut", "TRUNC(l_quantity / 8)", "trunc(l_quantity / 8)"),
    ("cut_two", "ROUND(TRUNC(l_quantity / 8, 2), 6)", "round(trunc(l_quantity / 8 * 100) / 100, 6)"),
    ("near", "ROUND(l_quantity / 8, 1)", "round(l_quantity / 8 + 1e-12, 1)"),
    ("sign_", "SIGN(l_linenumber - 3)", "CAST(sign(l_linenumber - 3) AS BIGINT)"),
    ("whole", "DIV(l_partkey, 13)", "l_partkey // 13"),
    ("rest", "MOD(l_partkey, 13)", "l_partkey % 13"),
    key="l_orderkey, l_linenumber",
)
suite(
    "math_logs", "part",
    ("e", "ROUND(EXP(p_size / 10), 6)", "round(exp(p_size / 10), 6)"),
    ("l", "ROUND(LN(p_size), 9)", "round(ln(p_size), 9)"),
    ("l10", "ROUND(LOG10(p_size), 9)", "round(log10(p_size), 9)"),
    ("lb", "ROUND(LOG(p_size, 3), 9)", "round(ln(p_size) / ln(3), 9)"),
    ("root", "ROUND(SQRT(p_size), 9)", "round(sqrt(p_size), 9)"),
    ("power_", "ROUND(POWER(p_size, 1.5), 4)", "round(pow(p_size, 1.5), 4)"),
    ("divided", "IEEE_DIVIDE(p_size, 8)", "p_size / 8"),
    ("by_zero", "IS_INF(IEEE_DIVIDE(p_size, 0))", "true"),
    ("none", "IS_NAN(IEEE_DIVIDE(p_size - p_size, 0))", "true"),
    ("finite", "IS_INF(p_retailprice) OR IS_NAN(p_retailprice)", "false"),
    key="p_partkey",
)
suite(
    "math_trigonometry", "nation",
    ("c", "ROUND(COS(n_nationkey), 9)", "round(cos(n_nationkey), 9)"),
    ("t", "ROUND(TAN(n_nationkey), 6)", "round(tan(n_nationkey), 6)"),
    ("as_", "ROUND(ASIN(n_nationkey / 25), 9)", "round(asin(n_nationkey / 25), 9)"),
    ("ac", "ROUND(ACOS(n_nationkey / 25), 9)", "round(acos(n_nationkey / 25), 9)"),
    ("at_", "ROUND(ATAN(n_nationkey), 9)", "round(atan(n_nationkey), 9)"),
    ("sh", "ROUND(SINH(n_nationkey / 5), 6)", "round(sinh(n_nationkey / 5), 6)"),
    ("ch", "ROUND(COSH(n_nationkey / 5), 6)", "round(cosh(n_nationkey / 5), 6)"),
    ("th", "ROUND(TANH(n_nationkey / 5), 9)", "round(tanh(n_nationkey / 5), 9)"),
    ("ash", "ROUND(ASINH(n_nationkey), 9)", "round(asinh(n_nationkey), 9)"),
    ("ach", "ROUND(ACOSH(n_nationkey + 1), 9)", "round(acosh(n_nationkey + 1), 9)"),
    ("ath", "ROUND(ATANH(n_nationkey / 25), 9)", "round(atanh(n_nationkey / 25), 9)"),
    key="n_nationkey",
)
suite(
    "math_safe_bits", "nation",
    ("negated", "SAFE_NEGATE(n_nationkey)", "-CAST(n_nationkey AS BIGINT)"),
    ("no_negative", "SAFE_NEGATE(-9223372036854775807 - MOD(n_nationkey, 2))", "CASE WHEN n_nationkey % 2 = 1 THEN NULL ELSE 9223372036854775807 END"),
    ("subtracted", "SAFE_SUBTRACT(-9223372036854775800, n_nationkey)", "CASE WHEN n_nationkey > 8 THEN NULL ELSE CAST(-9223372036854775800 - n_nationkey AS BIGINT) END"),
    ("multiplied", "SAFE_MULTIPLY(4611686018427387904, n_nationkey)", "CASE WHEN n_nationkey > 1 THEN NULL ELSE CAST(4611686018427387904 * n_nationkey AS BIGINT) END"),
    ("bits", "BIT_COUNT(n_nationkey * 1001)", "CAST(bit_count(CAST(n_nationkey * 1001 AS BIGINT)) AS BIGINT)"),
    ("bits_of_bytes", "BIT_COUNT(CAST(n_name AS BYTES))", "CAST(length(replace(CAST(CAST(encode(n_name) AS BIT) AS VARCHAR), '0', '')) AS BIGINT)"),
    ("reversed_twice", "BIT_REVERSE(BIT_REVERSE(n_nationkey, TRUE), TRUE)", "CAST(n_nationkey AS BIGINT)"),
    ("reversed", "BIT_REVERSE(n_nationkey * 2, TRUE)", "CAST(list_sum(list_transform(range(0, 62), lambda i: ((n_nationkey * 2 >> i) & 1) * (CAST(1 AS HUGEINT) << CAST(62 - i AS INTEGER)))) AS BIGINT)"),
    key="n_nationkey",
)
suite(
    "vector_distances", "embeddings a CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) b",
    ("cosine", "ROUND(APPROX_COSINE_DISTANCE(a.embedding, b.q, options => JSON '{\"num_leaves_to_search\": 10}'), 5)", "round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.q AS DOUBLE[])), 5)"),
    ("euclid", "ROUND(APPROX_EUCLIDEAN_DISTANCE(a.embedding, b.q), 4)", "round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.q AS DOUBLE[])), 4)"),
    ("dot", "ROUND(APPROX_DOT_PRODUCT(a.embedding, b.q), 4)", "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.q AS DOUBLE[])), 4)"),
    key="vec_id",
)
# dates and times
suite(
    "timestamp_arithmetic", "events",
    ("later", "TIMESTAMP_DIFF(TIMESTAMP_ADD(TIMESTAMP_SECONDS(1700000000), INTERVAL MOD(event_id, 100) MINUTE), TIMESTAMP_SECONDS(1700000000), SECOND)", "(event_id % 100) * 60"),
    ("earlier", "UNIX_SECONDS(TIMESTAMP_SUB(TIMESTAMP_SECONDS(1700000000), INTERVAL MOD(event_id, 100) HOUR))", "1700000000 - (event_id % 100) * 3600"),
    ("hour_", "UNIX_SECONDS(TIMESTAMP_TRUNC(TIMESTAMP_SECONDS(1700000000 + event_id), HOUR))", "(1700000000 + event_id) // 3600 * 3600"),
    ("day_", "UNIX_SECONDS(TIMESTAMP_TRUNC(TIMESTAMP_SECONDS(1700000000 + event_id), DAY, 'UTC'))", "(1700000000 + event_id) // 86400 * 86400"),
    ("millis", "UNIX_MILLIS(TIMESTAMP_MILLIS(1700000000123 + event_id))", "1700000000123 + event_id"),
    ("micros", "UNIX_MICROS(TIMESTAMP_MICROS(1700000000123456 + event_id))", "1700000000123456 + event_id"),
    ("text", "FORMAT_TIMESTAMP('%Y-%m-%dT%H:%M:%S', TIMESTAMP(DATE_FROM_UNIX_DATE(MOD(event_id, 9000)), 'UTC'), 'UTC')", "strftime(TIMESTAMP '1970-01-01' + to_days(CAST(event_id % 9000 AS INTEGER)), '%Y-%m-%dT%H:%M:%S')"),
    ("parsed", "UNIX_SECONDS(PARSE_TIMESTAMP('%Y-%m-%d %H:%M:%S', CONCAT('2024-03-05 10:', LPAD(CAST(MOD(event_id, 60) AS STRING), 2, '0'), ':07'), 'UTC'))", "1709632807 + (event_id % 60) * 60"),
    ("now", "CURRENT_TIMESTAMP() > TIMESTAMP '2024-01-01 00:00:00+00' AND CURRENT_DATE() > DATE '2024-01-01'", "true"),
    key="event_id",
)
suite(
    "date_arithmetic_more", "orders",
    ("added", "ADDDATE(DATE(o_orderdate), MOD(o_orderkey, 50))", "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INTEGER) AS DATE)"),
    ("taken", "SUBDATE(DATE(o_orderdate), MOD(o_orderkey, 50))", "CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER) AS DATE)"),
    ("from_day", "DATE_FROM_UNIX_DATE(UNIX_DATE(DATE(o_orderdate)) + 1)", "CAST(CAST(o_orderdate AS DATE) + 1 AS DATE)"),
    ("made", "DATE(EXTRACT(YEAR FROM o_orderdate), EXTRACT(MONTH FROM o_orderdate), 1)", "CAST(date_trunc('month', o_orderdate) AS DATE)"),
    ("parsed", "PARSE_DATE('%Y%m%d', FORMAT_DATE('%Y%m%d', DATE(o_orderdate)))", "CAST(o_orderdate AS DATE)"),
    ("named", "FORMAT_DATE('%A %d %B %Y', DATE(o_orderdate))", "strftime(o_orderdate, '%A %d %B %Y')"),
    ("of_year", "FORMAT_DATE('%j', DATE(o_orderdate))", "strftime(o_orderdate, '%j')"),
    ("weeks", "DATE_DIFF(DATE(o_orderdate), DATE '1992-01-05', WEEK)", "CAST(floor(date_diff('day', DATE '1992-01-05', CAST(o_orderdate AS DATE)) / 7) AS BIGINT)"),
    ("quarters", "DATE_DIFF(DATE(o_orderdate), DATE '1992-01-05', QUARTER)", "date_diff('quarter', DATE '1992-01-05', CAST(o_orderdate AS DATE))"),
    ("quarter_", "DATE_TRUNC(DATE(o_orderdate), QUARTER)", "CAST(date_trunc('quarter', o_orderdate) AS DATE)"),
    ("month_end", "DATE_SUB(DATE_ADD(DATE_TRUNC(DATE(o_orderdate), MONTH), INTERVAL 1 MONTH), INTERVAL 1 DAY)", "CAST(last_day(o_orderdate) AS DATE)"),
    key="o_orderkey",
)
suite(
    "intervals", "nation",
    ("days", "CAST(JUSTIFY_DAYS(MAKE_INTERVAL(0, 0, 30 + n_nationkey)) AS STRING)", "CASE WHEN n_nationkey = 0 THEN 'P1M' ELSE 'P1M' || n_nationkey || 'D' END"),
    ("hours", "CAST(JUSTIFY_HOURS(MAKE_INTERVAL(0, 0, 0, 24 + MOD(n_nationkey, 24))) AS STRING)", "CASE WHEN n_nationkey % 24 = 0 THEN 'P1D' ELSE 'P1DT' || (n_nationkey % 24) || 'H' END"),
    ("both", "CAST(JUSTIFY_INTERVAL(MAKE_INTERVAL(1, 1, 31, 25)) AS STRING)", "'P1Y2M2DT1H'"),
    ("part_", "EXTRACT(DAY FROM INTERVAL 3 DAY) + n_nationkey", "CAST(3 + n_nationkey AS BIGINT)"),
    ("added", "DATE_ADD(DATE '2024-01-31', INTERVAL n_nationkey MONTH)", "CAST(DATE '2024-01-31' + to_months(n_nationkey) AS DATE)"),
    key="n_nationkey",
)
# arrays
A = "GENERATE_ARRAY(1, 1 + MOD(n_nationkey, 6))"
B = "range(1, CAST(n_nationkey % 6 + 2 AS BIGINT))"
suite(
    "array_suite", f"(SELECT n_nationkey, n_regionkey, {A} AS a FROM nation)",
    ("joined", "ARRAY_TO_STRING(ARRAY(SELECT CAST(x AS STRING) FROM UNNEST(ARRAY_CONCAT(a, [n_regionkey])) AS x WITH OFFSET AS i ORDER BY i), ',')", "array_to_string(list_concat(a, [n_regionkey]), ',')"),
    ("turned", "ARRAY_REVERSE(a)[OFFSET(0)]", "len(a)"),
    ("has", "ARRAY_INCLUDES(a, 3)", "list_contains(a, 3)"),
    ("has_any", "ARRAY_INCLUDES_ANY(a, [4, 9])", "list_has_any(a, [4, 9])"),
    ("has_all", "ARRAY_INCLUDES_ALL(a, [2, 3])", "list_has_all(a, [2, 3])"),
    ("first_", "ARRAY_FIRST(a)", "a[1]"), ("last_", "ARRAY_LAST(a)", "a[len(a)]"),
    ("least_", "ARRAY_MIN(a)", "list_min(a)"), ("most", "ARRAY_MAX(a)", "list_max(a)"),
    ("sliced", "ARRAY_LENGTH(ARRAY_SLICE(a, 1, 2))", "CAST(len(a[2:3]) AS BIGINT)"),
    ("filtered", "ARRAY_LENGTH(ARRAY(SELECT x FROM UNNEST(a) AS x WHERE x > 2))", "CAST(len(list_filter(a, lambda x: x > 2)) AS BIGINT)"),
    ("mapped", "ARRAY_TO_STRING(ARRAY(SELECT CAST(x * x AS STRING) FROM UNNEST(a) AS x WITH OFFSET AS i ORDER BY i), '-')", "array_to_string(list_transform(a, lambda x: x * x), '-')"),
    ("without_null", "ARRAY_LENGTH(ARRAY_FILTER([n_regionkey, NULL]))", "CAST(1 AS BIGINT)"),
    ("as_is", "ARRAY_LENGTH(ARRAY_TRANSFORM(a))", "CAST(len(a) AS BIGINT)"),
    ("distinct_", "ARRAY_IS_DISTINCT(ARRAY_CONCAT(a, [1 + n_regionkey]))", "NOT list_contains(a, 1 + n_regionkey)"),
    ("long", "ARRAY_LENGTH(a)", "CAST(len(a) AS BIGINT)"),
    key="n_nationkey", oracle_source=f"(SELECT n_nationkey, n_regionkey, {B} AS a FROM nation)",
)
# hashes and network
suite(
    "hash_more", "documents",
    ("sha1", "TO_HEX(SHA1(text))", "sha1(text)"),
    ("zstd", "ZSTD_DECOMPRESS_TO_STRING(ZSTD_COMPRESS(text)) = text", "true"),
    ("zstd_bytes", "TO_HEX(MD5(ZSTD_DECOMPRESS_TO_BYTES(ZSTD_COMPRESS(CAST(text AS BYTES)))))", "md5(text)"),
    ("sha512", "LENGTH(TO_HEX(SHA512(text)))", "CAST(128 AS BIGINT)"),
    ("farm", "FARM_FINGERPRINT(text) = FARM_FINGERPRINT(CONCAT(text, ''))", "true"),
    key="doc_id",
)
add("sha512_known", "SELECT TO_HEX(SHA512('abc')) AS s", "SELECT 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS s")
suite(
    "net_suite", "nation",
    ("suffix", "NET.PUBLIC_SUFFIX(CONCAT('www.site', CAST(n_nationkey AS STRING), '.com'))", "'com'"),
    ("domain", "NET.REG_DOMAIN(CONCAT('www.site', CAST(n_nationkey AS STRING), '.com'))", "'site' || n_nationkey || '.com'"),
    ("host", "NET.HOST(CONCAT('https://USER@Www.Site', CAST(n_nationkey AS STRING), '.com:81/a?b=c'))", "'www.site' || n_nationkey || '.com'"),
    ("from_text", "TO_HEX(NET.IP_FROM_STRING(CONCAT('10.0.', CAST(n_nationkey AS STRING), '.1')))", "'0a00' || lower(printf('%02x', n_nationkey)) || '01'"),
    ("safe_text", "NET.SAFE_IP_FROM_STRING(CONCAT('10.0.x.', CAST(n_nationkey AS STRING))) IS NULL", "true"),
    ("to_text", "NET.IP_TO_STRING(NET.IPV4_FROM_INT64(n_nationkey * 65536 + 258))", "'0.' || n_nationkey || '.1.2'"),
    ("to_number", "NET.IPV4_TO_INT64(NET.IP_FROM_STRING(CONCAT('1.2.3.', CAST(n_nationkey AS STRING))))", "CAST(16909056 + n_nationkey AS BIGINT)"),
    ("mask", "TO_HEX(NET.IP_NET_MASK(4, n_nationkey))", "lower(printf('%08x', CAST(((1 << n_nationkey) - 1) << (32 - n_nationkey) AS BIGINT)))"),
    ("cut", "NET.IP_TO_STRING(NET.IP_TRUNC(NET.IP_FROM_STRING(CONCAT('1.2.', CAST(n_nationkey AS STRING), '.4')), 16))", "'1.2.0.0'"),
    key="n_nationkey", oracle_source="(SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)",
)
# JSON
J = "JSON_OBJECT('id', n_nationkey, 'name', n_name, 'tags', JSON_ARRAY(n_regionkey, 'x', NULL), 'in', JSON_OBJECT('b', n_nationkey > 9, 'z', NULL))"
K = "SELECT n_nationkey, n_regionkey, n_name, json_object('id', n_nationkey, 'name', n_name, 'tags', json_array(n_regionkey, 'x', NULL), 'in', json_object('b', n_nationkey > 9, 'z', NULL)) AS j FROM nation"
suite(
    "json_reading", f"(SELECT n_nationkey, n_regionkey, n_name, {J} AS j FROM nation)",
    ("text", "TO_JSON_STRING(j)", "CAST(j AS VARCHAR)"),
    ("query", "TO_JSON_STRING(JSON_QUERY(j, '$.in'))", "CAST(json_extract(j, '$.in') AS VARCHAR)"),
    ("items", "ARRAY_LENGTH(JSON_QUERY_ARRAY(j, '$.tags'))", "CAST(json_array_length(j, '$.tags') AS BIGINT)"),
    ("values_", "ARRAY_TO_STRING(JSON_VALUE_ARRAY(j, '$.tags'), ',', 'none')", "n_regionkey || ',x,none'"),
    ("kind", "CONCAT(JSON_TYPE(j), JSON_TYPE(JSON_QUERY(j, '$.tags')), JSON_TYPE(JSON_QUERY(j, '$.id')), JSON_TYPE(JSON_QUERY(j, '$.name')), JSON_TYPE(JSON_QUERY(j, '$.in.b')))", "'objectarraynumberstringboolean'"),
    ("number", "INT64(JSON_QUERY(j, '$.id'))", "CAST(n_nationkey AS BIGINT)"),
    ("float_", "FLOAT64(JSON_QUERY(j, '$.id')) + 0.5", "n_nationkey + 0.5::DOUBLE"),
    ("bool_", "BOOL(JSON_QUERY(j, '$.in.b'))", "n_nationkey > 9"),
    ("string_", "STRING(JSON_QUERY(j, '$.name'))", "n_name"),
    ("lax_int", "LAX_INT64(JSON_QUERY(j, '$.name'))", "CAST(NULL AS BIGINT)"),
    ("lax_bool", "LAX_BOOL(JSON_QUERY(j, '$.in.b'))", "n_nationkey > 9"),
    ("lax_float", "LAX_FLOAT64(JSON_QUERY(j, '$.id'))", "CAST(n_nationkey AS DOUBLE)"),
    ("lax_text", "LAX_STRING(JSON_QUERY(j, '$.id'))", "CAST(n_nationkey AS VARCHAR)"),
    ("keys_", "ARRAY_TO_STRING(JSON_KEYS(JSON_QUERY(j, '$.in')), ',')", "'b,z'"),
    ("safe", "JSON_VALUE(SAFE_TO_JSON(STRUCT(n_name AS a)), '$.a')", "n_name"),
    key="n_nationkey", oracle_source=f"({K})",
)
suite(
    "json_changing", f"(SELECT n_nationkey, n_regionkey, n_name, {J} AS j FROM nation)",
    ("set_", "JSON_VALUE(JSON_SET(j, '$.new.at', n_regionkey), '$.new.at')", "CAST(n_regionkey AS VARCHAR)"),
    ("stripped", "TO_JSON_STRING(JSON_QUERY(JSON_STRIP_NULLS(j), '$.in'))", "CASE WHEN n_nationkey > 9 THEN '{\"b\":true}' ELSE '{\"b\":false}' END"),
    ("appended", "TO_JSON_STRING(JSON_QUERY(JSON_ARRAY_APPEND(j, '$.tags', n_nationkey), '$.tags'))", "'[' || n_regionkey || ',\"x\",null,' || n_nationkey || ']'"),
    ("inserted", "TO_JSON_STRING(JSON_QUERY(JSON_ARRAY_INSERT(j, '$.tags[1]', n_nationkey), '$.tags'))", "'[' || n_regionkey || ',' || n_nationkey || ',\"x\",null]'"),
    ("removed", "TO_JSON_STRING(JSON_QUERY(JSON_REMOVE(j, '$.in.z'), '$.in'))", "CASE WHEN n_nationkey > 9 THEN '{\"b\":true}' ELSE '{\"b\":false}' END"),
    ("contains_", "JSON_CONTAINS(j, JSON '{\"in\": {\"b\": true}}')", "n_nationkey > 9"),
    ("parsed", "TO_JSON_STRING(PARSE_JSON(CONCAT('[', CAST(n_nationkey AS STRING), ', {\"a\" : 1}]')))", "'[' || n_nationkey || ',{\"a\":1}]'"),
    ("made", "TO_JSON_STRING(TO_JSON(STRUCT(n_nationkey AS k, [n_name] AS l)))", "'{\"k\":' || n_nationkey || ',\"l\":[\"' || n_name || '\"]}'"),
    key="n_nationkey", oracle_source=f"({K})",
)
suite(
    "json_arrays", "nation",
    ("ints", "INT64_ARRAY(JSON_ARRAY(n_nationkey, 2))[OFFSET(0)]", "CAST(n_nationkey AS BIGINT)"),
    ("floats", "FLOAT64_ARRAY(JSON_ARRAY(n_nationkey, 2.5))[OFFSET(1)]", "2.5::DOUBLE"),
    ("singles", "CAST(FLOAT32_ARRAY(JSON_ARRAY(n_nationkey, 2.5))[OFFSET(0)] AS FLOAT64)", "CAST(n_nationkey AS DOUBLE)"),
    ("bools", "BOOL_ARRAY(JSON_ARRAY(n_nationkey > 5))[OFFSET(0)]", "n_nationkey > 5"),
    ("strings", "STRING_ARRAY(JSON_ARRAY(n_name, 'x'))[OFFSET(0)]", "n_name"),
    key="n_nationkey",
)
# full-text search
W = "string_split_regex(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s#]', '', 'g')), '\\s+')"
suite(
    "search_tokens", "nation",
    ("token", "DEBUG_TOKENLIST(TOKEN(n_name))", "lower(n_name)"),
    ("full", "SEARCH(TOKENIZE_FULLTEXT(CONCAT('a ', n_name, ' of old')), 'old china')", "n_name = 'CHINA'"),
    ("either", "SEARCH(TOKENIZE_FULLTEXT(n_name), 'china OR japan')", "n_name IN ('CHINA', 'JAPAN')"),
    ("without", "SEARCH(TOKENIZE_FULLTEXT(CONCAT('land ', n_name)), 'land -china')", "n_name <> 'CHINA'"),
    ("substring_", "SEARCH_SUBSTRING(TOKENIZE_SUBSTRING(n_name), 'an')", "contains(lower(n_name), 'an')"),
    ("ngrams", "SEARCH_NGRAMS(TOKENIZE_NGRAMS(n_name, ngram_size_min => 3, ngram_size_max => 3), 'ania')", "contains(lower(n_name), 'ania')"),
    ("joined", "SEARCH(TOKENLIST_CONCAT([TOKENIZE_FULLTEXT(n_name), TOKENIZE_FULLTEXT('extra')]), 'extra')", "true"),
    ("score_", "SCORE(TOKENIZE_FULLTEXT(CONCAT(n_name, ' word')), 'word') > 0", "true"),
    ("score_n", "SCORE_NGRAMS(TOKENIZE_FULLTEXT(CONCAT('n', n_name)), CONCAT('n', n_name))", "1.0::DOUBLE"),
    ("number_", "DEBUG_TOKENLIST(TOKENIZE_NUMBER(n_nationkey)) IS NOT NULL", "true"),
    ("bool_", "DEBUG_TOKENLIST(TOKENIZE_BOOL(n_nationkey > 5)) IS NOT NULL", "true"),
    ("json_", "DEBUG_TOKENLIST(TOKENIZE_JSON(JSON_OBJECT('a', n_name))) IS NOT NULL", "true"),
    ("snip", "SNIPPET(CONCAT('the land of ', n_name), n_name) IS NOT NULL", "true"),
    key="n_nationkey",
)
add("search_either", "SELECT doc_id FROM documents WHERE SEARCH(TOKENIZE_FULLTEXT(text), 'apache OR mit')", f"SELECT doc_id FROM documents WHERE list_contains({W}, 'apache') OR list_contains({W}, 'mit')")

# formats and search queries that are no literals
FORMATS = {0: "%Y-%m-%d", 1: "%d.%m.%Y", 2: "day %j of %Y", 3: "%A, %B", 4: "%y/%m"}
_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in FORMATS.items())
_SHOWN = "CASE n_regionkey " + " ".join(f"WHEN {k} THEN strftime(d, '{v}')" for k, v in FORMATS.items()) + " END"
suite(
    "column_formats", f"(SELECT n_nationkey, CASE n_regionkey {_CASES} END AS f, CASE MOD(n_nationkey, 2) WHEN 0 THEN '%Y-%m-%d' ELSE '%d.%m.%Y' END AS g, DATE_ADD(DATE '2024-02-20', INTERVAL n_nationkey DAY) AS d FROM nation)",
    ("shown", "FORMAT_DATE(f, d)", _SHOWN),
    ("stamp", "FORMAT_TIMESTAMP(CONCAT(f, ' %H:%M:%S'), TIMESTAMP(d, 'UTC'), 'UTC')", f"{_SHOWN} || ' 00:00:00'"),
    ("read", "PARSE_DATE(g, FORMAT_DATE(g, d))", "d"),
    ("read_stamp", "UNIX_SECONDS(PARSE_TIMESTAMP(CONCAT(g, ' %H'), CONCAT(FORMAT_DATE(g, d), ' 07'), 'UTC'))", "CAST(epoch(d) + 25200 AS BIGINT)"),
    key="n_nationkey",
    oracle_source="(SELECT n_nationkey, n_regionkey, CAST(DATE '2024-02-20' + n_nationkey AS DATE) AS d FROM nation)",
)
suite(
    "column_searches", "nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    ("own", "SEARCH(TOKENIZE_FULLTEXT(CONCAT(n.n_name, ' in ', r.r_name)), CONCAT(r.r_name, ' ', n.n_name))", "true"),
    ("none", "SEARCH(TOKENIZE_FULLTEXT(n.n_name), CONCAT('-\"', n.n_name, '\"'))", "false"),
    ("other", "SEARCH(TOKENIZE_FULLTEXT(r.r_name), CONCAT('asia OR ', IF(n.n_nationkey > 9, 'europe', 'africa')))", "r.r_name IN ('ASIA', CASE WHEN n.n_nationkey > 9 THEN 'EUROPE' ELSE 'AFRICA' END)"),
    ("substring_", "SEARCH_SUBSTRING(TOKENIZE_SUBSTRING(n.n_name), SUBSTR(r.r_name, 1, 2))", "contains(lower(n.n_name), lower(substr(r.r_name, 1, 2)))"),
    ("score_", "SCORE(TOKENIZE_FULLTEXT(CONCAT(r.r_name, ' ', n.n_name)), n.n_name) > 0", "true"),
    key="n_nationkey",
)
