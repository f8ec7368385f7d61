"""Dates, timestamps and intervals. Timestamps are read in America/Los_Angeles unless a zone is given; the session runs in UTC."""

from __future__ import annotations

import contextlib
import re

from ..errors import InvalidArgument, Unimplemented
from .base import X, cast, fn, q, rejected, simple

ZONE = "'America/Los_Angeles'"
# Microseconds of each part that has a fixed length.
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}


def local(x: X, zone: str = ZONE) -> str:
    """Wall-clock time of a timestamp in a zone; dates and times without a zone as they are."""
    return f"from_utc_timestamp({x.sql}, {zone})" if x.type == "TIMESTAMP" else f"cast({x.sql} as timestamp)"


def stamp(x: X) -> X:
    """x as TIMESTAMP: strings without a zone, and dates, are taken in the default zone."""
    if x.type == "STRING":
        text = x.sql
        zoned = rf"regexp_like({text}, '(?i)(Z|[+-]\\d\\d?(:?\\d\\d)?|UTC|[A-Za-z]+/[A-Za-z_]+)$') AND regexp_like({text}, ':|Z$|/')"
        return X(f"IF({zoned}, cast({text} as timestamp), to_utc_timestamp(cast({text} as timestamp), {ZONE}))", "TIMESTAMP")
    if x.type == "DATE":
        return X(f"to_utc_timestamp(cast({x.sql} as timestamp), {ZONE})", "TIMESTAMP")
    return x


def day(x: X, zone: str = ZONE) -> str:
    """x as a date."""
    if x.type == "DATE":
        return x.sql
    if x.type == "STRING":
        return f"cast({x.sql} as date)"
    return f"cast({local(x, zone)} as date)"


simple("CURRENT_TIMESTAMP PENDING_COMMIT_TIMESTAMP", "current_timestamp()", "TIMESTAMP", 0, 1)
simple("CURRENT_DATE", "cast(current_timestamp() as date)", "DATE", 0, 1)


@fn("TIMESTAMP", 1, 2)
def _timestamp(c, a):
    if len(a) == 2:
        x = a[0]
        return X(f"to_utc_timestamp(cast({x.sql} as timestamp), {a[1].sql})", "TIMESTAMP")
    return stamp(a[0])


@fn("DATE", 1, 3)
def _date(c, a):
    if len(a) == 3:
        return X(f"make_date({', '.join(cast(x, 'INT64') for x in a)})" if not c.safe else f"try_cast(concat_ws('-', {', '.join(x.sql for x in a)}) as date)", "DATE")
    return X(day(a[0], a[1].sql if len(a) > 1 else ZONE), "DATE")


def sunday(d: str) -> str:
    return f"date_sub({d}, dayofweek({d}) - 1)"


def monday(d: str) -> str:
    return f"date_sub({d}, weekday({d}))"


def iso_year_start(d: str) -> str:
    year = f"extract(YEAROFWEEK FROM {d})"
    return monday(f"make_date({year}, 1, 4)")


def extract(c, part: str, x: X, zone: str | None) -> X:
    if x.type == "INTERVAL":
        f = {"YEAR": f"{x.sql}.months div 12", "MONTH": f"{x.sql}.months % 12", "DAY": f"{x.sql}.days"}
        nanos = f"{x.sql}.nanos"
        f |= {"HOUR": f"{nanos} div 3600000000000", "MINUTE": f"({nanos} div 60000000000) % 60", "SECOND": f"({nanos} div 1000000000) % 60", "MILLISECOND": f"({nanos} div 1000000) % 1000", "MICROSECOND": f"({nanos} div 1000) % 1000000", "NANOSECOND": f"{nanos} % 1000000000"}
        if part not in f:
            raise InvalidArgument(f"EXTRACT({part} FROM INTERVAL)")
        return X(f"cast({f[part]} as bigint)", "INT64")
    if x.type not in ("DATE", "TIMESTAMP", "DATETIME", "NULL"):
        raise InvalidArgument(f"EXTRACT from {x.type}")
    t = local(x, zone or ZONE)
    d = x.sql if x.type == "DATE" else f"cast({t} as date)"
    if part == "DATE":
        return X(d, "DATE")
    sub = f"(unix_micros({t}) % 1000000 + 1000000) % 1000000"
    forms = {
        "YEAR": f"year({d})", "MONTH": f"month({d})", "DAY": f"day({d})", "QUARTER": f"quarter({d})", "DAYOFWEEK": f"dayofweek({d})", "DAYOFYEAR": f"dayofyear({d})", "ISOWEEK": f"weekofyear({d})",
        "ISOYEAR": f"extract(YEAROFWEEK FROM {d})", "WEEK": f"(dayofyear({d}) + 7 - dayofweek({d})) div 7",
        "HOUR": f"hour({t})", "MINUTE": f"minute({t})", "SECOND": f"second({t})", "MILLISECOND": f"({sub}) div 1000", "MICROSECOND": sub, "NANOSECOND": f"({sub}) * 1000",
    }
    if part not in forms or x.type == "DATE" and part in ("HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND", "NANOSECOND"):
        raise InvalidArgument(f"EXTRACT({part} FROM {x.type})")
    return X(f"cast({forms[part]} as bigint)", "INT64")


def _step(x: X) -> tuple[X, str]:
    if x.interval is None:
        raise InvalidArgument("INTERVAL n part is needed")
    return x.interval


def _timestamp_add(sign):
    def build(c, a):
        n, part = _step(a[1])
        t = stamp(a[0])
        if part == "NANOSECOND":
            micros = f"({n.sql} div 1000)"
        elif part in MICROS:
            micros = f"{n.sql} * {MICROS[part]}"
        else:
            raise InvalidArgument(f"TIMESTAMP_ADD does not take {part}")
        out = f"timestamp_micros(unix_micros(cast({t.sql} as timestamp)) {sign} {micros})"
        return X(f"cast({out} as timestamp_ntz)" if t.type == "DATETIME" else out, t.type)

    return build


fn("TIMESTAMP_ADD", 2)(_timestamp_add("+"))
fn("TIMESTAMP_SUB", 2)(_timestamp_add("-"))


@fn("TIMESTAMP_DIFF", 3)
def _timestamp_diff(c, a):
    part = word(a[2])
    x, y = (f"unix_micros(cast({stamp(v).sql} as timestamp))" for v in a[:2])
    if part == "NANOSECOND":
        return X(f"(({x} - {y}) * 1000)", "INT64")
    if part not in MICROS:
        raise InvalidArgument(f"TIMESTAMP_DIFF does not take {part}")
    return X(f"(({x} - {y}) div {MICROS[part]})", "INT64")


def word(x: X) -> str:
    """A part given as a bare word."""
    w = x.extra.get("word")
    if not w:
        raise InvalidArgument("a date part is needed")
    return w.upper()


def _truncated(d: str, part: str) -> str:
    forms = {"DAY": d, "WEEK": sunday(d), "ISOWEEK": monday(d), "MONTH": f"trunc({d}, 'MM')", "QUARTER": f"trunc({d}, 'QUARTER')", "YEAR": f"trunc({d}, 'YYYY')", "ISOYEAR": iso_year_start(d)}
    if part not in forms:
        raise InvalidArgument(f"cannot truncate to {part}")
    return forms[part]


@fn("TIMESTAMP_TRUNC", 2, 3)
def _timestamp_trunc(c, a):
    part, zone, x = word(a[1]), a[2].sql if len(a) > 2 else ZONE, stamp(a[0])
    if part in ("NANOSECOND", "MICROSECOND"):
        return x
    t = local(x, zone)
    if part in ("MILLISECOND", "SECOND", "MINUTE", "HOUR"):
        out = f"date_trunc('{part}', {t})"
    else:
        out = f"cast({_truncated(f'cast({t} as date)', part)} as timestamp)"
    return X(f"to_utc_timestamp({out}, {zone})" if x.type == "TIMESTAMP" else f"cast({out} as timestamp_ntz)", x.type)


@fn("DATE_TRUNC", 2, 3)
def _date_trunc(c, a):
    return X(_truncated(day(a[0]), word(a[1])), "DATE")


def _date_add(sign):
    def build(c, a):
        n, part = _step(a[1]) if a[1].interval else (a[1], "DAY")
        d, k = day(a[0]), f"cast({sign}({n.sql}) as int)"
        forms = {"DAY": f"date_add({d}, {k})", "WEEK": f"date_add({d}, 7 * {k})", "MONTH": f"add_months({d}, {k})", "QUARTER": f"add_months({d}, 3 * {k})", "YEAR": f"add_months({d}, 12 * {k})"}
        if part not in forms:
            raise InvalidArgument(f"DATE_ADD does not take {part}")
        return X(forms[part], "DATE")

    return build


fn("DATE_ADD ADDDATE", 2)(_date_add(""))
fn("DATE_SUB SUBDATE", 2)(_date_add("-"))


@fn("DATE_DIFF", 3)
def _date_diff(c, a):
    part, x, y = word(a[2]), day(a[0]), day(a[1])
    week = lambda d, shift: f"floor((unix_date({d}) + {shift}) / 7D)"
    forms = {
        "DAY": f"datediff({x}, {y})", "WEEK": f"({week(x, 4)} - {week(y, 4)})", "ISOWEEK": f"({week(x, 3)} - {week(y, 3)})", "MONTH": f"((year({x}) - year({y})) * 12 + month({x}) - month({y}))",
        "QUARTER": f"((year({x}) - year({y})) * 4 + quarter({x}) - quarter({y}))", "YEAR": f"(year({x}) - year({y}))", "ISOYEAR": f"(extract(YEAROFWEEK FROM {x}) - extract(YEAROFWEEK FROM {y}))",
    }
    if part not in forms:
        raise InvalidArgument(f"DATE_DIFF does not take {part}")
    return X(f"cast({forms[part]} as bigint)", "INT64")


rejected("LAST_DAY", "Function not found: LAST_DAY")
_CODE = re.compile(r"%(E[*#0-9]?S|E[a-zA-Z]|O[a-zA-Z]|[a-zA-Z%])")
# Format codes that a Java pattern prints.
_PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "X": "HH:mm:ss", "x": "MM/dd/yy", "j": "DDD", "c": "EEE MMM d HH:mm:ss yyyy", "Q": "Q"}


def formatted(fmt: str, t: str, zone: str | None, ts: str | None) -> str:
    """SQL that prints wall-clock time t by the codes of fmt."""
    out, at = [], 0
    d = f"cast({t} as date)"
    java = lambda p: f"date_format({t}, {q(p)})"
    for m in _CODE.finditer(fmt):
        if m.start() > at:
            out.append(q(fmt[at : m.start()]))
        at, k = m.end(), m[1]
        micros = f"lpad(cast((unix_micros({t}) % 1000000 + 1000000) % 1000000 as string), 6, '0')"
        if k in _PATTERNS:
            out.append(java(_PATTERNS[k]))
        elif k == "%":
            out.append("'%'")
        elif k in "nt":
            out.append(q({"n": "\n", "t": "\t"}[k]))
        elif k == "e":
            out.append(f"lpad(cast(day({d}) as string), 2, ' ')")
        elif k in "kl":
            out.append(f"lpad({java('H' if k == 'k' else 'h')}, 2, ' ')")
        elif k == "u":
            out.append(f"cast(weekday({d}) + 1 as string)")
        elif k == "w":
            out.append(f"cast(dayofweek({d}) - 1 as string)")
        elif k in "UW":
            shift = f"dayofweek({d})" if k == "U" else f"weekday({d}) + 1"
            out.append(f"lpad(cast((dayofyear({d}) + 7 - ({shift})) div 7 as string), 2, '0')")
        elif k == "V":
            out.append(f"lpad(cast(weekofyear({d}) as string), 2, '0')")
        elif k in "Gg":
            out.append(f"cast(extract(YEAROFWEEK FROM {d}) {'% 100' if k == 'g' else ''} as string)")
        elif k == "C":
            out.append(f"lpad(cast(year({d}) div 100 as string), 2, '0')")
        elif k == "s":
            out.append(f"cast(unix_seconds({ts or t}) as string)")
        elif k == "E*S":
            out.append(f"concat({java('ss')}, IF({micros} = '000000', '', concat('.', regexp_replace({micros}, '0+$', ''))))")
        elif re.fullmatch(r"E\dS", k):
            n = int(k[1])
            out.append(java("ss") if n == 0 else f"concat({java('ss')}, '.', substring(concat({micros}, '000'), 1, {n}))")
        elif k == "E4Y":
            out.append(java("yyyy"))
        elif k in "zZ" and ts:
            minutes = f"cast((unix_seconds({t}) - unix_seconds({ts})) div 60 as int)"
            offset = f"concat(IF({minutes} < 0, '-', '+'), lpad(cast(abs({minutes}) div 60 as string), 2, '0'), '{'' if k == 'z' else ':'}', lpad(cast(abs({minutes}) % 60 as string), 2, '0'))"
            out.append(offset if k == "z" else f"IF({zone} = 'UTC', 'UTC', concat('UTC', IF({minutes} < 0, '-', '+'), cast(abs({minutes}) div 60 as string)))")
        else:
            raise Unimplemented(f"format code %{k}")
    if fmt[at:]:
        out.append(q(fmt[at:]))
    return f"concat({', '.join(out) or q('')})"


#: Codes that a format which is not a literal may have.
ALL_CODES = [*"aAbBcCdDeFgGhHIjklmMnpQRsStTuUVwWxXyYzZ%", "E*S", *[f"E{n}S" for n in range(10)], "E4Y"]
#: A format as an array of codes and of what stands between them.
PIECES = "regexp_extract_all({}, '(%(?:E[*0-9]S|E4Y|.)|[^%]+)', 1)"


def by_code(fmt: X, one, plain: str) -> str:
    """SQL that goes through a format known at run time: one(code) is the SQL for a code, plain for text p between codes."""
    whens = []
    for k in ALL_CODES:
        with contextlib.suppress(Unimplemented):
            whens.append(f"WHEN {q('%' + k)} THEN {one(k)}")
    pieces = PIECES.format(fmt.sql)
    return f"array_join(transform({pieces}, p -> CASE p {' '.join(whens)} ELSE IF(startswith(p, '%'), raise_error(concat('format code ', p)), {plain}) END), '')"


def printed(fmt: X, t: str, zone: str | None, ts: str | None) -> str:
    if fmt.lit and isinstance(fmt.lit[0], str):
        return formatted(fmt.lit[0], t, zone, ts)
    return f"IF({t} IS NULL, NULL, {by_code(fmt, lambda k: formatted('%' + k, t, zone, ts), 'p')})"


def pattern_of(fmt: X) -> str:
    if fmt.lit and isinstance(fmt.lit[0], str):
        return q(java_pattern(fmt.lit[0]))
    quoted = "regexp_replace(replace(p, '\\'', '\\'\\''), '([A-Za-z])', '\\'$1\\'')"
    return by_code(fmt, lambda k: q(java_pattern("%" + k)), quoted)


@fn("FORMAT_TIMESTAMP", 2, 3)
def _format_timestamp(c, a):
    x, zone = stamp(a[1]), a[2].sql if len(a) > 2 else ZONE
    return X(printed(a[0], local(x, zone), zone, x.sql if x.type == "TIMESTAMP" else None), "STRING")


@fn("FORMAT_DATE", 2)
def _format_date(c, a):
    return X(printed(a[0], f"cast({day(a[1])} as timestamp)", None, None), "STRING")


def java_pattern(fmt: str) -> str:
    out, at = "", 0
    put = lambda s: "".join("''" if ch == "'" else f"'{ch}'" if ch.isalpha() else ch for ch in s)
    for m in _CODE.finditer(fmt):
        out += put(fmt[at : m.start()])
        at, k = m.end(), m[1]
        p = {"e": "d", "z": "XX", "E*S": "ss[.SSSSSS]", "E4Y": "yyyy", "%": "%", "k": "H", "l": "h", "Z": "VV"}.get(k) or _PATTERNS.get(k)
        if not p:
            raise Unimplemented(f"format code %{k}")
        out += p
    return out + put(fmt[at:])


@fn("PARSE_TIMESTAMP", 2, 3)
def _parse_timestamp(c, a):
    zone = a[2].sql if len(a) > 2 else ZONE
    f = "try_to_timestamp" if c.safe else "to_timestamp"
    parsed = f"{f}({a[1].sql}, {pattern_of(a[0])})"
    if not a[0].lit:
        return X(f"IF(regexp_like({a[0].sql}, '%[zZ]'), {parsed}, to_utc_timestamp({parsed}, {zone}))", "TIMESTAMP")
    return X(parsed if re.search("%[zZ]", a[0].lit[0] or "") else f"to_utc_timestamp({parsed}, {zone})", "TIMESTAMP")


@fn("PARSE_DATE", 2)
def _parse_date(c, a):
    return X(f"cast({'try_to_timestamp' if c.safe else 'to_timestamp'}({a[1].sql}, {pattern_of(a[0])}) as date)", "DATE")


for _name in ("SECONDS", "MILLIS", "MICROS"):
    fn(f"UNIX_{_name}", 1)(lambda c, a, n=_name: X(f"unix_{n.lower()}(cast({stamp(a[0]).sql} as timestamp))", "INT64"))
    simple(f"TIMESTAMP_{_name}", f"timestamp_{_name.lower()}({{0}})", "TIMESTAMP")
simple("UNIX_DATE", "cast(unix_date({0}) as bigint)", "INT64")
simple("DATE_FROM_UNIX_DATE", "date_from_unix_date(cast({0} as int))", "DATE")


@fn("GENERATE_DATE_ARRAY", 2, 3)
def _dates(c, a):
    n, part = _step(a[2]) if len(a) > 2 else (X("1", "INT64"), "DAY")
    unit = {"DAY": ("days", 1), "WEEK": ("days", 7), "MONTH": ("months", 1), "QUARTER": ("months", 3), "YEAR": ("months", 12)}.get(part)
    if not unit:
        raise InvalidArgument(f"GENERATE_DATE_ARRAY does not take {part}")
    k = f"cast({n.sql} * {unit[1]} as int)"
    step = f"make_interval(0, {k if unit[0] == 'months' else 0}, 0, {k if unit[0] == 'days' else 0})"
    x, y = day(a[0]), day(a[1])
    body = f"IF(({k} > 0 AND {x} <= {y}) OR ({k} < 0 AND {x} >= {y}), sequence({x}, {y}, {step}), cast(array() as array<date>))"
    return X(f"IF({x} IS NULL OR {y} IS NULL OR {k} IS NULL, NULL, {c.guard(f'{k} = 0', 'step of GENERATE_DATE_ARRAY is 0', body)})", ("ARRAY", "DATE"))


rejected("GENERATE_TIMESTAMP_ARRAY", "Function not found: GENERATE_TIMESTAMP_ARRAY")


def interval(months: str = "0", days: str = "0", nanos: str = "0") -> str:
    return f"named_struct('months', cast({months} as int), 'days', cast({days} as int), 'nanos', cast({nanos} as bigint))"


def interval_literal(n: X, part: str | None) -> X:
    if n.type == "STRING":
        raise Unimplemented("INTERVAL with a string")
    v = cast(n, "INT64")
    months, days = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}, {"WEEK": 7, "DAY": 1}
    if part in months:
        sql = interval(months=f"{v} * {months[part]}")
    elif part in days:
        sql = interval(days=f"{v} * {days[part]}")
    elif part == "NANOSECOND" or part in MICROS:
        sql = interval(nanos=f"{v} * {MICROS.get(part, 0) * 1000 or 1}")
    else:
        raise InvalidArgument(f"unknown part {part}")
    return X(sql, "INTERVAL", interval=(n, part))


@fn("MAKE_INTERVAL", 0, 6)
def _make_interval(c, a):
    v = [x.sql for x in a] + ["0"] * (6 - len(a))
    return X(interval(f"{v[0]} * 12 + {v[1]}", v[2], f"({v[3]} * 3600 + {v[4]} * 60 + {v[5]}) * 1000000000"), "INTERVAL")


_HOURS = 24 * 3600 * 10**9


@fn("JUSTIFY_DAYS", 1)
def _justify_days(c, a):
    x = a[0].sql
    return X(interval(f"{x}.months + {x}.days div 30", f"{x}.days % 30", f"{x}.nanos"), "INTERVAL")


@fn("JUSTIFY_HOURS", 1)
def _justify_hours(c, a):
    x = a[0].sql
    return X(interval(f"{x}.months", f"{x}.days + {x}.nanos div {_HOURS}", f"{x}.nanos % {_HOURS}"), "INTERVAL")


@fn("JUSTIFY_INTERVAL", 1)
def _justify(c, a):
    return _justify_days(c, [_justify_hours(c, a)])


def interval_text(x: str) -> str:
    """ISO 8601 text of an interval."""
    part = lambda v, unit: f"IF({v} = 0, '', concat(cast({v} as string), '{unit}'))"
    n = f"{x}.nanos"
    second = f"({n} % 60000000000)"
    sec = f"IF({second} = 0, '', concat(regexp_replace(cast(cast({second} as decimal(20,0)) / 1000000000 as string), '\\\\.?0+$', ''), 'S'))"
    time = f"concat({part(f'({n} div 3600000000000)', 'H')}, {part(f'(({n} div 60000000000) % 60)', 'M')}, {sec})"
    days = f"concat({part(f'({x}.months div 12)', 'Y')}, {part(f'({x}.months % 12)', 'M')}, {part(f'{x}.days', 'D')})"
    return f"IF({x}.months = 0 AND {x}.days = 0 AND {n} = 0, 'P0Y', concat('P', {days}, IF({n} = 0, '', concat('T', {time}))))"
