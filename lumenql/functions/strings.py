"""String and bytes functions."""

from __future__ import annotations

import re

from ..errors import InvalidArgument, Unimplemented
from .base import X, cast, fn, q, rejected, simple, wants

same = lambda t: t[0]


def is_bytes(x: X) -> bool:
    return x.type == "BYTES"


@fn("LENGTH CHAR_LENGTH CHARACTER_LENGTH", 1)
def _length(c, a):
    wants(a[0], "STRING", "BYTES")
    return X(f"cast({'octet_length' if is_bytes(a[0]) else 'char_length'}({a[0].sql}) as bigint)", "INT64")


simple("BYTE_LENGTH OCTET_LENGTH", "cast(octet_length({0}) as bigint)", "INT64")
simple("LOWER LCASE", "lower({0})", same)
simple("UPPER UCASE", "upper({0})", same)


def _trim(which):
    def build(c, a):
        if is_bytes(a[0]):
            return X(f"{c.udf('bytes_trim')}({a[0].sql}, {a[1].sql if len(a) > 1 else 'cast(null as binary)'}, {q(which)})", "BYTES")
        x = a[0].sql
        if len(a) == 1:
            pattern = {"BOTH": r"^\s+|\s+$", "LEADING": r"^\s+", "TRAILING": r"\s+$"}[which]
            return X(f"regexp_replace({x}, {q('(?U)' + pattern)}, '')", "STRING")
        return X(f"trim({which} {a[1].sql} FROM {x})", "STRING")

    return build


fn("TRIM", 1, 2)(_trim("BOTH"))
fn("LTRIM", 1, 2)(_trim("LEADING"))
fn("RTRIM", 1, 2)(_trim("TRAILING"))


@fn("CONCAT", 1, 99)
def _concat(c, a):
    t = "BYTES" if any(map(is_bytes, a)) else "STRING"
    return X(f"concat({', '.join(cast(x, t) for x in a)})", t)


@fn("STARTS_WITH", 2)
def _starts(c, a):
    return X(f"startswith({a[0].sql}, {a[1].sql})", "BOOL")


@fn("ENDS_WITH", 2)
def _ends(c, a):
    return X(f"endswith({a[0].sql}, {a[1].sql})", "BOOL")


@fn("SUBSTR SUBSTRING", 2, 3)
def _substr(c, a):
    v, p = a[0].sql, a[1].sql
    n = f"{'octet_length' if is_bytes(a[0]) else 'char_length'}({v})"
    at = f"cast(CASE WHEN {p} = 0 OR {p} < -{n} THEN 1 WHEN {p} > 2147483647 THEN 2147483647 ELSE {p} END as int)"
    if len(a) == 2:
        return X(f"substring({v}, {at})", a[0].type)
    size = f"cast(least({a[2].sql}, 2147483647) as int)"
    return X(c.guard(f"{a[2].sql} < 0", "Third argument of SUBSTR is negative", f"substring({v}, {at}, {size})"), a[0].type)


@fn("LEFT", 2)
def _left(c, a):
    return _substr(c, [a[0], X("1", "INT64"), a[1]])


@fn("RIGHT", 2)
def _right(c, a):
    v, n = a[0].sql, a[1].sql
    size = f"{'octet_length' if is_bytes(a[0]) else 'char_length'}({v})"
    return X(c.guard(f"{n} < 0", "Second argument of RIGHT is negative", f"substring({v}, cast(greatest({size} - {n}, 0) + 1 as int))"), a[0].type)


@fn("REPLACE", 3)
def _replace(c, a):
    if is_bytes(a[0]):
        return X(f"{c.udf('bytes_replace')}({', '.join(x.sql for x in a)})", "BYTES")
    return X(f"IF({a[1].sql} = '', {a[0].sql}, replace({a[0].sql}, {a[1].sql}, {a[2].sql}))", "STRING")


@fn("REVERSE", 1)
def _reverse(c, a):
    return X(f"{c.udf('bytes_reverse')}({a[0].sql})" if is_bytes(a[0]) else f"reverse({a[0].sql})", a[0].type)


@fn("STRPOS", 2)
def _strpos(c, a):
    if is_bytes(a[0]):
        return X(f"{c.udf('bytes_find')}({a[0].sql}, {a[1].sql})", "INT64")
    return X(f"cast(instr({a[0].sql}, {a[1].sql}) as bigint)", "INT64")


@fn("INSTR", 2)
def _instr(c, a):
    return _strpos(c, a)


def split_sql(v: str, d: str) -> str:
    """Parts of v by the literal delimiter d; an empty one gives characters."""
    return f"CASE WHEN {d} = '' THEN IF({v} = '', array(''), filter(split({v}, ''), e -> e <> '')) ELSE split({v}, concat('\\\\Q', {d}, '\\\\E')) END"


@fn("SPLIT", 1, 2)
def _split(c, a):
    if is_bytes(a[0]):
        if len(a) < 2:
            raise InvalidArgument("SPLIT of BYTES needs a delimiter")
        return X(f"{c.udf('bytes_split')}({a[0].sql}, {a[1].sql})", ("ARRAY", "BYTES"))
    return X(split_sql(a[0].sql, a[1].sql if len(a) > 1 else "','"), ("ARRAY", "STRING"))


@fn("SPLIT_SUBSTR", 3, 4)
def _split_substr(c, a):
    parts = split_sql(a[0].sql, a[1].sql)
    n, s = f"size({parts})", a[2].sql
    start = f"CASE WHEN {s} = 0 OR {s} < -{n} THEN 1 WHEN {s} < 0 THEN {n} + {s} + 1 ELSE {s} END"
    count = a[3].sql if len(a) > 3 else "2147483647"
    out = f"CASE WHEN {start} > {n} OR {count} = 0 THEN '' ELSE array_join(slice({parts}, cast({start} as int), cast(least({count}, {n}) as int)), {a[1].sql}) END"
    bad = f"{a[1].sql} IS NULL OR {s} IS NULL" + (f" OR {count} < 0" if len(a) > 3 else "")
    return X(f"IF({a[0].sql} IS NULL, NULL, {c.guard(bad, 'invalid argument of SPLIT_SUBSTR', out)})", "STRING")


def _pad(side):
    def build(c, a):
        v, n = a[0].sql, a[1].sql
        pad = a[2].sql if len(a) > 2 else ("X'20'" if is_bytes(a[0]) else "' '")
        size = "octet_length" if is_bytes(a[0]) else "char_length"
        return X(c.guard(f"{n} < 0 OR {size}({pad}) = 0", f"invalid argument of {side.upper()}", f"{side}({v}, cast({n} as int), {pad})"), a[0].type)

    return build


fn("LPAD", 2, 3)(_pad("lpad"))
fn("RPAD", 2, 3)(_pad("rpad"))


@fn("REPEAT", 2)
def _repeat(c, a):
    body = f"unhex(repeat(hex({a[0].sql}), cast({a[1].sql} as int)))" if is_bytes(a[0]) else f"repeat({a[0].sql}, cast({a[1].sql} as int))"
    return X(c.guard(f"{a[1].sql} < 0", "Second argument of REPEAT is negative", body), a[0].type)


_BAD = re.compile(r"\\[1-9]|\(\?(?:=|!|<=|<!|>)|[*+?}]\+|\\[kGZ]")


def pattern(x: X) -> str | None:
    """A literal pattern, checked against what RE2 takes; None if it is not a literal."""
    if x.lit is None or x.lit[0] is None:
        return None
    text = x.lit[0]
    if isinstance(text, bytes):
        text = text.decode("latin-1")
    if _BAD.search(re.sub(r"\\\\", "", text)):
        raise InvalidArgument(f"invalid regular expression {text!r}")
    try:
        re.compile(re.sub(r"\(\?P<", "(?P<", re.sub(r"\\[pPzQE]", "x", text)))
    except re.error:
        if text.count("(") != text.count(")") and "\\" not in text:
            raise InvalidArgument(f"invalid regular expression {text!r}") from None
    return text


def groups(text: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?(?!P<|<[a-zA-Z]))", re.sub(r"\\\\|\[[^\]]*\]", "", text)))


def java(x: X) -> str:
    """The pattern in Java's syntax."""
    text = pattern(x)
    return x.sql if text is None else q(text.replace("(?P<", "(?<"))


@fn("REGEXP_CONTAINS", 2)
def _contains(c, a):
    return X(f"regexp_like({cast(a[0], 'STRING')}, {java(a[1])})", "BOOL")


def _group(x: X) -> int:
    text = pattern(x)
    n = groups(text) if text is not None else 0
    if n > 1:
        raise InvalidArgument("a regular expression with several groups")
    return n


@fn("REGEXP_EXTRACT", 2)
def _extract(c, a):
    return X(f"IF(regexp_like({a[0].sql}, {java(a[1])}), regexp_extract({a[0].sql}, {java(a[1])}, {_group(a[1])}), NULL)", a[0].type)


@fn("REGEXP_EXTRACT_ALL", 2)
def _extract_all(c, a):
    return X(f"regexp_extract_all({a[0].sql}, {java(a[1])}, {_group(a[1])})", ("ARRAY", "STRING"))


@fn("REGEXP_REPLACE", 3)
def _regexp_replace(c, a):
    to = a[2].sql
    if a[2].lit and isinstance(a[2].lit[0], str):
        to = q(re.sub(r"\\(\d)", r"$\1", a[2].lit[0].replace("$", "\\$")))
    return X(f"regexp_replace({a[0].sql}, {java(a[1])}, {to})", a[0].type)


@fn("REGEXP_INSTR", 2, 3)
def _regexp_instr(c, a):
    if len(a) == 2:
        return X(f"cast(regexp_instr({a[0].sql}, {java(a[1])}) as bigint)", "INT64")
    s = a[2].sql
    found = f"regexp_instr(substring({a[0].sql}, cast({s} as int)), {java(a[1])})"
    return X(f"cast(CASE WHEN {s} < 1 OR {s} > char_length({a[0].sql}) THEN 0 WHEN {found} = 0 THEN 0 ELSE {found} + {s} - 1 END as bigint)", "INT64")


rejected("LIKE_ANY LIKE_ALL", "LIKE ANY is not supported")


@fn("TO_HEX", 1)
def _to_hex(c, a):
    return X(f"lower(hex({a[0].sql}))", "STRING")


simple("FROM_HEX", "to_binary(IF(length({0}) % 2 = 1, concat('0', {0}), {0}), 'hex')", "BYTES")


@fn("CODE_POINTS_TO_STRING CHR", 1)
def _chr(c, a):
    v = a[0].sql if isinstance(a[0].type, tuple) else f"array({a[0].sql})"
    return X(f"{c.udf('code_points')}({v})", "STRING")


@fn("TO_CODE_POINTS", 1)
def _points(c, a):
    return X(f"{c.udf('byte_values' if is_bytes(a[0]) else 'points')}({a[0].sql})", ("ARRAY", "INT64"))


simple("CODE_POINTS_TO_BYTES", "to_binary(array_join(transform({0}, e -> lpad(hex(e), 2, '0')), ''), 'hex')", "BYTES")


def _udf(names, udf, out, least=1, most=None):
    fn(names, least, most)(lambda c, a: X(f"{c.udf(udf)}({', '.join(x.sql for x in a)})", out if out is not None else a[0].type))


_udf("SOUNDEX", "soundex", "STRING")
_udf("FROM_BASE32", "from_base32", "BYTES")
_udf("TO_BASE32", "to_base32", "STRING")


@fn("NORMALIZE", 1, 2)
def _normalize(c, a):
    mode = a[1].extra.get("word") or (a[1].lit or ("NFC",))[0] if len(a) > 1 else "NFC"
    if str(mode).upper() not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise InvalidArgument(f"unknown normal form {mode}")
    return X(f"{c.udf('normalize')}({a[0].sql}, {q(str(mode).upper())})", "STRING")


@fn("NORMALIZE_AND_CASEFOLD", 1, 2)
def _casefold(c, a):
    return X(f"lower({_normalize(c, a).sql})", "STRING")


simple("SAFE_CONVERT_BYTES_TO_STRING", "make_valid_utf8(cast({0} as string))", "STRING")
simple("FROM_BASE64", "unbase64({0})", "BYTES")
simple("TO_BASE64", "replace(replace(base64({0}), '\\r', ''), '\\n', '')", "STRING")
simple("GENERATE_UUID", "uuid()", "STRING", 0)
simple("NEW_UUID", "uuid()", "UUID", 0)
_SPEC = re.compile(r"%(?P<flags>[-+ 0#']*)(?P<width>\d+)?(?:\.(?P<digits>\d+))?(?P<code>[diouxXfFeEgGstT%])")


@fn("FORMAT", 1, 99)
def _format(c, a):
    if a[0].type == "NULL" or a[0].lit and a[0].lit[0] is None:
        return X("cast(null as string)", "STRING")
    if not a[0].lit:
        raise Unimplemented("FORMAT needs a literal format")
    text, out, at, rest = a[0].lit[0], [], 0, list(a[1:])
    for m in _SPEC.finditer(text):
        if text[at : m.start()].count("%"):
            raise InvalidArgument(f"invalid format {text!r}")
        if m.start() > at:
            out.append(q(text[at : m.start()]))
        at = m.end()
        if m["code"] == "%":
            out.append("'%'")
            continue
        if not rest:
            raise InvalidArgument("too few arguments of FORMAT")
        x, code = rest.pop(0), m["code"]
        if code in "tT":
            one = f"coalesce({c.literal_text(x) if code == 'T' else c.text(x)}, 'NULL')"
        elif code == "s":
            one = c.text(x)
            one = f"substring({one}, 1, {m['digits']})" if m["digits"] else one
        else:
            flags = m["flags"].replace("'", ",").replace("#", "" if code in "diu" else "#")
            spec = "%" + flags + (m["width"] or "") + (f".{m['digits']}" if m["digits"] and code in "fFeEgG" else "") + {"i": "d", "u": "d", "F": "f"}.get(code, code)
            value = cast(x, "INT64" if code in "diouxX" else "FLOAT64")
            one = f"IF({x.sql} IS NULL, NULL, format_string({q(spec)}, {value}))"
            out.append(one)
            continue
        if m["width"]:
            one = f"CASE WHEN char_length({one}) >= {m['width']} THEN {one} ELSE {'rpad' if '-' in m['flags'] else 'lpad'}({one}, {m['width']}, ' ') END"
        out.append(one)
    if rest:
        raise InvalidArgument("too many arguments of FORMAT")
    if text[at:].count("%"):
        raise InvalidArgument(f"invalid format {text!r}")
    if text[at:]:
        out.append(q(text[at:]))
    return X(f"concat({', '.join(out) or q('')})", "STRING")

