"""Functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import base64
import ipaddress
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

UDFS: dict[str, tuple] = {}


def udf(name: str, out: str):
    """Registers a function of one row's values; any NULL argument gives NULL."""

    def put(f):
        UDFS[name] = (f, out)
        return f

    return put


def register(spark: SparkSession) -> None:
    for name, (f, out) in UDFS.items():
        spark.udf.register(f"lq_{name}", vectorised(f, out))
        spark.udf.register(f"lq_safe_{name}", vectorised(f, out, True))


def vectorised(f, out: str, safe: bool = False):
    def one(*v):
        if any(x is None or x is pd.NA or isinstance(x, float) and x != x for x in v):
            return None
        try:
            return f(*v)
        except Exception:
            if safe:
                return None
            raise

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    # pandas UDFs take a fixed number of arguments by their signature
    n = f.__code__.co_argcount
    names = ", ".join(f"a{i}: pd.Series" for i in range(n))
    scope = {"run": run, "pd": pd}
    exec(f"def g({names}) -> pd.Series:\n    return run({', '.join(f'a{i}' for i in range(n))})", scope)  # noqa: S102
    return pandas_udf(scope["g"], out)


@udf("bytes_reverse", "binary")
def _reverse(v):
    return bytes(v)[::-1]


@udf("bytes_replace", "binary")
def _replace(v, old, new):
    return bytes(v).replace(bytes(old), bytes(new)) if old else bytes(v)


@udf("bytes_find", "bigint")
def _find(v, sub):
    return bytes(v).find(bytes(sub)) + 1


@udf("bytes_split", "array<binary>")
def _split(v, d):
    return bytes(v).split(bytes(d)) if d else [bytes([x]) for x in bytes(v)]


@udf("bytes_trim", "binary")
def _trim(v, chars, which):
    f = {"BOTH": bytes.strip, "LEADING": bytes.lstrip, "TRAILING": bytes.rstrip}[which]
    return f(bytes(v), bytes(chars))


@udf("bits", "string")
def _bits(v):
    return "".join(f"{x:08b}" for x in bytes(v))


@udf("code_points", "string")
def _code_points(v):
    return "".join(chr(int(x)) for x in v if x is not None and x == x)


@udf("points", "array<bigint>")
def _points(v):
    return [ord(x) for x in v]


@udf("byte_values", "array<bigint>")
def _byte_values(v):
    return list(bytes(v))


@udf("soundex", "string")
def _soundex(v):
    codes = dict(zip("bfpvcgjkqsxzdtlmnr", "111122222222334556", strict=True))
    letters = [x for x in v if x.isascii() and x.isalpha()]
    if not letters:
        return ""
    out, last = letters[0], codes.get(letters[0].lower())
    for x in letters[1:]:
        k = codes.get(x.lower())
        if k and k != last:
            out += k
        last = k or last
    return (out + "000")[:4]


@udf("normalize", "string")
def _normalize(v, mode):
    return unicodedata.normalize(mode, v)


@udf("from_base32", "binary")
def _from_base32(v):
    return base64.b32decode(v + "=" * (-len(v) % 8), casefold=True)


@udf("to_base32", "string")
def _to_base32(v):
    return base64.b32encode(bytes(v)).decode()


@udf("fnv", "bigint")
def _fnv(v):
    h = 0xCBF29CE484222325
    for x in bytes(v):
        h = (h ^ x) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


@udf("zstd", "binary")
def _zstd(v):
    import zstandard

    return zstandard.ZstdCompressor().compress(bytes(v))


@udf("unzstd", "binary")
def _unzstd(v):
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(bytes(v))


@udf("ip_from", "binary")
def _ip_from(v):
    return ipaddress.ip_address(v).packed


@udf("ip_from_safe", "binary")
def _ip_from_safe(v):
    try:
        return ipaddress.ip_address(v).packed
    except ValueError:
        return None


@udf("ip_text", "string")
def _ip_text(v):
    return str(ipaddress.ip_address(bytes(v)))


def _mask(size, prefix):
    size, prefix = int(size), int(prefix)
    if size not in (4, 16) or not 0 <= prefix <= size * 8:
        raise ValueError("invalid network mask")
    return ((1 << prefix) - 1) << (size * 8 - prefix)


@udf("ip_mask", "binary")
def _ip_mask(size, prefix):
    return _mask(size, prefix).to_bytes(int(size), "big")


@udf("ip_trunc", "binary")
def _ip_trunc(v, prefix):
    v = bytes(v)
    return (int.from_bytes(v, "big") & _mask(len(v), prefix)).to_bytes(len(v), "big")


# JSON


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _steps(path: str) -> list:
    if not path.startswith("$"):
        raise ValueError(f"invalid JSON path {path}")
    out, at = [], 1
    for m in re.finditer(r"""\.(?:"([^"]*)"|([^.\[\]"]+))|\[(?:(\d+)|"([^"]*)"|'([^']*)')\]""", path):
        if m.start() != at:
            raise ValueError(f"invalid JSON path {path}")
        at = m.end()
        out.append(int(m[3]) if m[3] is not None else next(g for g in (m[1], m[2], m[4], m[5]) if g is not None))
    if at != len(path):
        raise ValueError(f"invalid JSON path {path}")
    return out


_MISSING = object()


def _at(x, steps):
    for s in steps:
        if isinstance(s, int) and isinstance(x, list) and s < len(x) or isinstance(s, str) and isinstance(x, dict) and s in x:
            x = x[s]
        else:
            return _MISSING
    return x


def _node(text, path):
    try:
        return _at(json.loads(text), _steps(path))
    except json.JSONDecodeError:
        return _MISSING


@udf("json_compact", "string")
def _compact(v):
    return _dump(json.loads(v))


@udf("json_query", "string")
def _query(v, path):
    x = _node(v, path)
    return None if x is _MISSING else _dump(x)


@udf("json_query_array", "array<string>")
def _query_array(v, path):
    x = _node(v, path)
    return [_dump(e) for e in x] if isinstance(x, list) else None


@udf("json_value_array", "array<string>")
def _value_array(v, path):
    x = _node(v, path)
    return [None if e is None else e if isinstance(e, str) else _dump(e) for e in x] if isinstance(x, list) else None


@udf("json_set", "string")
def _set(v, rest):
    x = json.loads(v)
    for path, value in zip(rest[::2], rest[1::2], strict=True):
        steps, to = _steps(path), json.loads(value)
        if not steps:
            x = to
            continue
        at = x
        for s in steps[:-1]:
            if isinstance(at, dict) and isinstance(s, str):
                at = at.setdefault(s, {})
            elif isinstance(at, list) and isinstance(s, int) and s < len(at):
                at = at[s]
            else:
                at = None
                break
        s = steps[-1]
        if isinstance(at, dict) and isinstance(s, str) or isinstance(at, list) and isinstance(s, int) and s < len(at):
            at[s] = to
    return _dump(x)


@udf("json_append", "string")
def _append(v, rest):
    x = json.loads(v)
    at = _at(x, _steps(rest[0]))
    if isinstance(at, list):
        at.extend(json.loads(r) for r in rest[1:])
    elif not _steps(rest[0]):
        raise ValueError("JSON is no array")
    return _dump(x)


@udf("json_insert", "string")
def _insert(v, rest):
    x = json.loads(v)
    for path, value in zip(rest[::2], rest[1::2], strict=True):
        steps = _steps(path)
        at = _at(x, steps[:-1])
        if isinstance(at, list) and steps and isinstance(steps[-1], int):
            at.extend([None] * (steps[-1] - len(at)))
            at.insert(steps[-1], json.loads(value))
    return _dump(x)


@udf("json_remove", "string")
def _remove(v, rest):
    x = json.loads(v)
    for path in rest:
        if path is None:
            continue
        steps = _steps(path)
        at = _at(x, steps[:-1]) if steps else None
        if isinstance(at, dict) and steps[-1] in at or isinstance(at, list) and isinstance(steps[-1], int) and steps[-1] < len(at):
            del at[steps[-1]]
    return _dump(x)


@udf("json_strip", "string")
def _strip(v):
    def f(x):
        if isinstance(x, dict):
            return {k: f(e) for k, e in x.items() if e is not None}
        return [f(e) for e in x] if isinstance(x, list) else x

    return _dump(f(json.loads(v)))


@udf("json_contains", "boolean")
def _contains(v, w):
    def has(x, y):
        if isinstance(x, dict) and isinstance(y, dict):
            return all(k in x and has(x[k], e) for k, e in y.items())
        if isinstance(x, list):
            return all(any(has(i, e) for i in x) for e in y) if isinstance(y, list) else any(has(i, y) for i in x)
        return type(x) is type(y) and x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool) and x == y

    x, y = json.loads(v), json.loads(w)
    return None if x is None or y is None else has(x, y)


@udf("json_tokens", "array<string>")
def _tokens(v):
    out = []

    def walk(x, path):
        if isinstance(x, dict):
            for k, e in x.items():
                walk(e, f"{path}.{k}")
        elif isinstance(x, list):
            for e in x:
                walk(e, path)
        else:
            out.append(f"{path}={x if isinstance(x, str) else _dump(x)}".lower())

    walk(json.loads(v), "$")
    return list(dict.fromkeys(out))


@udf("snippet", "string")
def _snippet(text, query, width, many):
    terms = [w for w in re.sub(r"[^\w\s#]", "", query).lower().split() if w]
    low, found = text.lower(), []
    for t in terms:
        at = low.find(t)
        while at >= 0:
            found.append((at, at + len(t)))
            at = low.find(t, at + 1)
    found.sort()
    out, used = [], 0
    for a, b in found:
        if len(out) >= many:
            break
        if a < used:
            continue
        start = max(0, min(a - int(width - (b - a)) // 2, len(text) - int(width)))
        end = min(len(text), start + int(width))
        marks = [{"begin": str(x - start + 1), "end": str(y - start + 1)} for x, y in found if start <= x and y <= end]
        out.append({"highlights": marks, "snippet": text[start:end], "source_begin": str(start + 1), "source_end": str(end + 1)})
        used = end
    return _dump({"snippets": out})


def _plain_words(text: str) -> list[str]:
    return re.sub(r"[^\w\s#]", "", text).lower().split()


@udf("search", "boolean")
def _search(tokens, source, query, kind):
    """Whether a token list (its tokens, one a line, and its source) matches a query that is not a literal."""
    have, line = set(tokens.split("\n")), " " + " ".join(_plain_words(source)) + " "
    phrase = lambda v: " " + " ".join(_plain_words(v)) + " " in line
    if kind == "words_phrase":
        return phrase(query)
    if kind == "words":
        words = _plain_words(query)
        return bool(words) and all(w in have for w in words)
    found, pending = [], False
    for m in re.finditer(r'(-?)"([^"]*)"|(\||\bOR\b)|(-?)([^\s"|]+)', query):
        if m[3]:
            pending = True
            continue
        words = _plain_words(m[5]) if m[5] else []
        if m[2] is None and not words:
            continue
        one = phrase(m[2]) if m[2] is not None else all(w in have for w in words)
        one = not one if m[1] or m[4] else one
        if pending and found:
            found[-1] = found[-1] or one
        else:
            found.append(one)
        pending = False
    return bool(found) and all(found)
