"""Expressions against expected values, many in one query."""

import datetime
import math

import pytest

from lumenql import Database, InvalidArgument, NotFound, OutOfRange, Unimplemented

VALUES = [
    ("1 + 2 * 3", 7), ("7 / 2", 3.5), ("-5", -5), ("'a' || 'b'", "ab"), ("NOT 1 = 2", True), ("1 IN (1, 2)", True), ("3 NOT IN (1, 2)", True), ("NULL IS NULL", True), ("TRUE IS NOT FALSE", True),
    ("2 BETWEEN 1 AND 3", True), ("'abc' LIKE 'a%'", True), ("'abc' NOT LIKE '_'", True), ("CASE WHEN FALSE THEN 1 ELSE 2 END", 2), ("CASE 3 WHEN 3 THEN 'x' END", "x"), ("IF(NULL, 1, 2)", 2), ("COALESCE(NULL, 1, 2)", 1),
    ("IFNULL(NULL, 5)", 5), ("NULLIF(1, 1)", None), ("NULLIF(2, 1)", 2), ("CAST(2.5 AS INT64)", 3), ("CAST(-2.5 AS INT64)", -3), ("CAST('0x1F' AS INT64)", 31), ("SAFE_CAST('x' AS INT64)", None), ("CAST(1.0 AS STRING)", "1"),
    ("CAST(1.5 AS STRING)", "1.5"), ("CAST(TRUE AS STRING)", "true"), ("CAST('abc' AS BYTES)", b"abc"), ("CAST(b'abc' AS STRING)", "abc"), ("CAST('inf' AS FLOAT64)", math.inf), ("LENGTH('héllo')", 5), ("LENGTH(b'abc')", 3), ("BYTE_LENGTH('é')", 2),
    ("UPPER('abc')", "ABC"), ("TRIM('  a\\t')", "a"), ("LTRIM('xxa', 'x')", "a"), ("RTRIM('axx', 'x')", "a"), ("SUBSTR('hello', -10, 3)", "hel"), ("SUBSTR('hello', 0, 2)", "he"), ("SUBSTR('hello', 2)", "ello"), ("SUBSTR('hello', -3, 2)", "ll"),
    ("REPLACE('abc', '', 'x')", "abc"), ("REPLACE('abcabc', 'b', 'x')", "axcaxc"), ("REVERSE('abc')", "cba"), ("REVERSE(b'abc')", b"cba"), ("STRPOS('hello', 'l')", 3), ("SPLIT('a.b.c', '.')", ["a", "b", "c"]), ("SPLIT('abc', '')", ["a", "b", "c"]),
    ("LPAD('a', 3)", "  a"), ("RPAD('abc', 2)", "ab"), ("LPAD('a', 4, 'xy')", "xyxa"), ("REPEAT('ab', 2)", "abab"), ("REGEXP_CONTAINS('foo bar', r'o+\\s')", True), ("REGEXP_EXTRACT('abc123', r'[a-z]+(\\d+)')", "123"),
    ("REGEXP_EXTRACT('abc', r'\\d')", None), ("REGEXP_REPLACE('abc', r'(b)', r'<\\1>')", "a<b>c"), ("REGEXP_EXTRACT_ALL('a1b2', r'\\d')", ["1", "2"]), ("REGEXP_INSTR('abcb', 'b', 3)", 4), ("TO_HEX(b'\\x01\\xff')", "01ff"), ("FROM_HEX('01ff')", b"\x01\xff"),
    ("CODE_POINTS_TO_STRING([65, 233])", "Aé"), ("TO_CODE_POINTS('Aé')", [65, 233]), ("CODE_POINTS_TO_BYTES([1, 255])", b"\x01\xff"), ("SOUNDEX('tymczak')", "t520"), ("NORMALIZE('e\\u0301', NFC)", "é"), ("TO_BASE64(b'ab')", "YWI="),
    ("FROM_BASE64('YWI=')", b"ab"), ("TO_BASE32(b'ab')", "MFRA===="), ("FROM_BASE32('MFRA====')", b"ab"), ("SPLIT_SUBSTR('a.b.c', '.', 2)", "b.c"), ("SPLIT_SUBSTR('a.b.c', '.', -1)", "c"), ("SPLIT_SUBSTR('a.b.c', '.', 1, 2)", "a.b"), ("FORMAT('%d-%s', 5, 'x')", "5-x"), ("FORMAT('%05d|%.2f', 42, 3.14159)", "00042|3.14"),
    ("FORMAT('%t %T', 'a', 'a')", 'a "a"'), ("FORMAT('%d', NULL)", None), ("ABS(-3)", 3), ("MOD(7, 3)", 1), ("CEIL(1.2)", 2.0), ("FLOOR(-1.2)", -2.0), ("ROUND(-2.5)", -3.0), ("ROUND(123.456, 1)", 123.5), ("ROUND(125, -1)", 130.0), ("TRUNC(-1.75, 1)", -1.7),
    ("GREATEST(1, NULL)", None), ("GREATEST(1, 3, 2)", 3), ("LEAST(2.5, 1)", 1.0), ("SIGN(-3)", -1), ("DIV(7, 2)", 3), ("IEEE_DIVIDE(1, 0)", math.inf), ("SAFE_DIVIDE(1, 0)", None), ("SAFE_ADD(9223372036854775807, 1)", None), ("SAFE_MULTIPLY(3, 4)", 12),
    ("SQRT(9)", 3.0), ("POW(2, 10)", 1024.0), ("LOG(8, 2)", 3.0), ("LN(1)", 0.0), ("IS_NAN(CAST('nan' AS FLOAT64))", True), ("IS_INF(1.0)", False), ("BIT_COUNT(7)", 3), ("BIT_REVERSE(1, FALSE)", -(1 << 63)), ("BIT_REVERSE(1, TRUE)", 1 << 62),
    ("CAST('nan' AS FLOAT64) = CAST('nan' AS FLOAT64)", False), ("CAST('nan' AS FLOAT64) != 1.0", True), ("CAST('nan' AS FLOAT64) > 1.0", False), ("COSINE_DISTANCE([1.0, 0.0], [0.0, 1.0])", 1.0), ("EUCLIDEAN_DISTANCE([0.0, 3.0], [4.0, 0.0])", 5.0), ("DOT_PRODUCT([1, 2], [3, 4])", 11.0),
    ("DATE '2024-02-29'", datetime.date(2024, 2, 29)), ("DATE(2024, 1, 5)", datetime.date(2024, 1, 5)), ("EXTRACT(WEEK FROM DATE '2024-01-06')", 0), ("EXTRACT(WEEK FROM DATE '2024-01-07')", 1), ("EXTRACT(ISOWEEK FROM DATE '2024-01-01')", 1), ("EXTRACT(DAYOFWEEK FROM DATE '2024-01-07')", 1),
    ("EXTRACT(HOUR FROM TIMESTAMP '2024-01-01 12:00:00+00')", 4), ("DATE_ADD(DATE '2024-01-31', INTERVAL 1 MONTH)", datetime.date(2024, 2, 29)), ("DATE_SUB(DATE '2024-03-01', INTERVAL 1 DAY)", datetime.date(2024, 2, 29)), ("DATE_DIFF(DATE '2024-01-07', DATE '2024-01-06', WEEK)", 1),
    ("DATE_DIFF(DATE '2024-02-01', DATE '2024-01-31', MONTH)", 1), ("DATE_DIFF(DATE '2024-01-01', DATE '2023-12-31', ISOWEEK)", 1), ("DATE_TRUNC(DATE '2024-05-15', WEEK)", datetime.date(2024, 5, 12)), ("DATE_TRUNC(DATE '2024-05-15', QUARTER)", datetime.date(2024, 4, 1)), ("UNIX_DATE(DATE '1970-01-02')", 1),
    ("UNIX_SECONDS(TIMESTAMP '1970-01-01 00:00:01+00')", 1), ("TIMESTAMP_DIFF(TIMESTAMP '2024-01-01 01:30:00+00', TIMESTAMP '2024-01-01 00:00:00+00', HOUR)", 1), ("FORMAT_DATE('%Y/%m/%d %A', DATE '2024-01-05')", "2024/01/05 Friday"), ("PARSE_DATE('%Y-%m-%d', '2024-01-05')", datetime.date(2024, 1, 5)),
    ("FORMAT_TIMESTAMP('%F %T', TIMESTAMP '2024-01-01 12:00:00+00')", "2024-01-01 04:00:00"), ("FORMAT_TIMESTAMP('%F %T', TIMESTAMP '2024-01-01 12:00:00+00', 'UTC')", "2024-01-01 12:00:00"), ("CAST(TIMESTAMP '2024-01-01 12:00:00+00' AS STRING)", "2024-01-01 04:00:00-08"),
    ("GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE '2024-01-03')", [datetime.date(2024, 1, d) for d in (1, 2, 3)]), ("CAST(JUSTIFY_INTERVAL(MAKE_INTERVAL(0, 0, 35, 25)) AS STRING)", "P1M6DT1H"), ("EXTRACT(DAY FROM INTERVAL 3 DAY)", 3),
    ("ARRAY_LENGTH([1, 2])", 2), ("ARRAY_CONCAT([1], [2])", [1, 2]), ("ARRAY_TO_STRING(['a', NULL, 'b'], ',')", "a,b"), ("ARRAY_TO_STRING(['a', NULL], ',', 'n')", "a,n"), ("ARRAY_REVERSE([1, 2])", [2, 1]), ("GENERATE_ARRAY(1, 5, 2)", [1, 3, 5]), ("GENERATE_ARRAY(5, 1)", []),
    ("GENERATE_ARRAY(0.0, 1.0, 0.5)", [0.0, 0.5, 1.0]), ("ARRAY_INCLUDES([1, NULL], 2)", False), ("ARRAY_INCLUDES_ANY([1, 2], [2, 3])", True), ("ARRAY_INCLUDES_ALL([1, 2], [2, 3])", False), ("ARRAY_FIRST([3, 4])", 3), ("ARRAY_LAST([3, 4])", 4), ("ARRAY_MIN([3, NULL, 1])", 1),
    ("ARRAY_SLICE([1, 2, 3, 4], 1, -2)", [2, 3]), ("ARRAY_IS_DISTINCT([1, 1])", False), ("[10, 20][OFFSET(1)]", 20), ("[10, 20][ORDINAL(1)]", 10), ("[10][SAFE_OFFSET(5)]", None), ("STRUCT(1 AS a, 'x' AS b).b", "x"), ("1 IN UNNEST([1, 2])", True),
    ("JSON_VALUE(JSON '{\"a\": {\"b\": 5}}', '$.a.b')", "5"), ("JSON_VALUE(JSON '{\"a\": [1]}', '$.a')", None), ("JSON_QUERY(JSON '{\"b\": {\"z\": 1, \"a\": \"x\"}}', '$.b')", '{"z":1,"a":"x"}'), ("JSON_QUERY_ARRAY(JSON '[1, \"a\"]')", ["1", '"a"']), ("JSON_VALUE_ARRAY(JSON '[1, \"a\", null]')", ["1", "a", None]),
    ("JSON_TYPE(JSON '[1]')", "array"), ("JSON_TYPE(JSON 'null')", "null"), ("JSON_TYPE(JSON '1.5')", "number"), ("JSON_TYPE(JSON '{}')", "object"), ("BOOL(JSON 'true')", True), ("INT64(JSON '5')", 5), ("FLOAT64(JSON '1.5')", 1.5), ("STRING(JSON '\"x\"')", "x"), ("LAX_INT64(JSON '\"x\"')", None), ("JSON_ARRAY(1, 'a', NULL)", '[1,"a",null]'), ("JSON_OBJECT('a', 1, 'b', TRUE)", '{"a":1,"b":true}'),
    ("JSON_SET(JSON '{\"a\": 1}', '$.b.c', 2)", '{"a":1,"b":{"c":2}}'), ("JSON_STRIP_NULLS(JSON '{\"a\": null, \"b\": 1}')", '{"b":1}'), ("JSON_KEYS(JSON '{\"a\": 1, \"b\": 2}')", ["a", "b"]), ("JSON_ARRAY_APPEND(JSON '[1]', '$', 2)", "[1,2]"), ("JSON_ARRAY_INSERT(JSON '[1, 3]', '$[1]', 2)", "[1,2,3]"), ("JSON_CONTAINS(JSON '{\"a\": [1, 2]}', JSON '{\"a\": [2]}')", True),
    ("JSON_REMOVE(JSON '{\"a\": 1, \"b\": 2}', '$.a')", '{"b":2}'), ("INT64_ARRAY(JSON '[1, 2]')", [1, 2]), ("TO_JSON(STRUCT(1 AS a, [1.5, 2.0] AS b))", '{"a":1,"b":[1.5,2]}'), ("TO_JSON_STRING(JSON '{\"a\": 1}')", '{"a":1}'), ("TO_JSON('a\"b')", '"a\\"b"'),
    ("TO_HEX(SHA1('a'))", "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"), ("TO_HEX(MD5('a'))", "0cc175b9c0f1b6a831c399e269772661"), ("FARM_FINGERPRINT('')", -3750763034362895579), ("ZSTD_DECOMPRESS_TO_STRING(ZSTD_COMPRESS('abc'))", "abc"), ("NET.HOST('http://A.example.com:80/x')", "a.example.com"), ("NET.HOST('example.org/x')", "example.org"),
    ("NET.REG_DOMAIN('a.b.example.com')", "example.com"), ("NET.IP_TO_STRING(NET.IP_FROM_STRING('1.2.3.4'))", "1.2.3.4"), ("NET.SAFE_IP_FROM_STRING('x')", None), ("NET.IPV4_TO_INT64(b'\\x01\\x02\\x03\\x04')", 16909060), ("NET.IPV4_FROM_INT64(16909060)", b"\x01\x02\x03\x04"), ("NET.IP_TRUNC(b'\\x01\\x02\\x03\\x04', 16)", b"\x01\x02\x00\x00"),
    ("SEARCH(TOKENIZE_FULLTEXT('The quick brown fox'), 'quick fox')", True), ("SEARCH(TOKENIZE_FULLTEXT('The quick brown fox'), 'quick -fox')", False), ("SEARCH(TOKENIZE_FULLTEXT('The quick brown fox'), '\"brown fox\"')", True), ("SEARCH(TOKENIZE_FULLTEXT('a b'), 'z OR b')", True),
    ("SEARCH_SUBSTRING(TOKENIZE_SUBSTRING('hello world'), 'lo')", True), ("SEARCH_NGRAMS(TOKENIZE_NGRAMS('hello', 2, 3), 'hell')", True), ("DEBUG_TOKENLIST(TOKEN('Ab'))", "ab"), ("SCORE(TOKENIZE_FULLTEXT('a b a'), 'a')", 1 + math.log(2)), ("SCORE_NGRAMS(TOKENIZE_FULLTEXT('abcd'), 'abcd')", 1.0),
    ("SAFE.SUBSTR('a', 1, -1)", None), ("SAFE.LN(0)", None), ("SAFE.PARSE_DATE('%Y', 'x')", None), ("(SELECT 5)", 5), ("EXISTS (SELECT 1)", True), ("ARRAY(SELECT x FROM UNNEST([3, 1, 2]) AS x ORDER BY x DESC)", [3, 2, 1]), ("1 IN (SELECT 1)", True), ("@p + 1", 42),
    ("NUMERIC '1.5' / 2", __import__("decimal").Decimal("0.750000000")), ("CAST('2024-01-05' AS DATE)", datetime.date(2024, 1, 5)), ("DATE '2024-01-05' < '2024-01-06'", True), ("LEFT('abc', 2)", "ab"), ("RIGHT('abc', 2)", "bc"),
]


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark)


def test_values(db):
    wrong, size = [], 12
    for at in range(0, len(VALUES), size):
        part = VALUES[at : at + size]
        try:
            row = db.rows("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(part)), {"p": 41})[0]
            got = list(row)
        except Exception:
            got = []
            for e, _ in part:
                try:
                    got.append(db.rows(f"SELECT {e} AS c", {"p": 41})[0][0])
                except Exception as x:  # noqa: BLE001
                    got.append(f"{type(x).__name__}: {str(x)[:200]}")
        for (e, want), g in zip(part, got, strict=True):
            g = bytes(g) if isinstance(g, bytearray) else g
            if not (g == want and type(g) is type(want) or isinstance(want, float) and isinstance(g, float) and math.isclose(g, want, rel_tol=1e-12)):
                wrong.append((e, want, g))
    assert not wrong, "\n".join(map(str, wrong))


ERRORS = [
    ("SELECT 1 = NULL", InvalidArgument), ("SELECT NOT NULL", InvalidArgument), ("SELECT 7 % 2", Unimplemented), ("SELECT [1] = [1]", InvalidArgument), ("SELECT LAST_DAY(DATE '2024-01-01')", Unimplemented), ("SELECT NO_SUCH(1)", NotFound), ("SELECT SQRT(-1)", InvalidArgument),
    ("SELECT 1/0", OutOfRange), ("SELECT 9223372036854775807 + 1", OutOfRange), ("SELECT CAST('x' AS INT64)", InvalidArgument), ("SELECT a FROM UNNEST([1]) AS b", NotFound), ("SELECT 1 UNION SELECT 2", InvalidArgument), ("SELECT 1 UNION ALL SELECT 2 EXCEPT ALL SELECT 1", InvalidArgument),
    ("SELECT ROW_NUMBER() OVER (ORDER BY 1)", Unimplemented), ("SELECT REGEXP_CONTAINS('a', r'(?=a)')", InvalidArgument), ("SELECT 'a' LIKE ANY ('a')", Unimplemented), ("SELECT DISTINCT [1]", InvalidArgument), ("SELECT x FROM UNNEST([1]) AS x ORDER BY x NULLS LAST", Unimplemented), ("SELECT 1 LIMIT -1", InvalidArgument),
    ("SELECT 1 WHERE TRUE", InvalidArgument), ("SELECT JSON_EXTRACT('{}', '$')", Unimplemented), ("SELECT [1, 2][OFFSET(2)]", InvalidArgument), ("SELECT ARRAY_CONCAT([1], NULL)", InvalidArgument), ("SELECT TO_JSON_STRING(1)", InvalidArgument), ("SELECT (SELECT x FROM UNNEST([1, 2]) AS x)", InvalidArgument),
]


@pytest.mark.parametrize(("sql", "kind"), ERRORS)
def test_errors(db, sql, kind):
    with pytest.raises(kind):
        db.rows(sql)


def test_offset_of_the_instant(db):
    """Timestamps become text with the offset that Los Angeles has at that instant: an hour less from 2024-03-10 10:00 UTC on."""
    got = db.query("SELECT CAST(TIMESTAMP_SECONDS(1710064740) AS STRING) AS a, CAST(TIMESTAMP_SECONDS(1710064800) AS STRING) AS b").first()
    assert (got["a"], got["b"]) == ("2024-03-10 01:59:00-08", "2024-03-10 03:00:00-07")
