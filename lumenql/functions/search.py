"""Full-text search: token lists are structs of (kind, source, tokens, nmin, nmax)."""

from __future__ import annotations

import re

from ..errors import InvalidArgument, Unimplemented
from ..types import is_array
from .base import X, cast, fn, q

EMPTY = "cast(array() as array<string>)"


def words_sql(v: str) -> str:
    """Lower-case words without signs."""
    return f"filter(split(lower(regexp_replace({v}, '(?U)[^\\\\w\\\\s#]', '')), '\\\\s+'), e -> e <> '')"


def grams_sql(v: str, low: str, high: str) -> str:
    """All runs of low to high characters of v."""
    return f"flatten(transform(sequence({low}, {high}), n -> IF(char_length({v}) < n, {EMPTY}, transform(sequence(1, char_length({v}) - n + 1), p -> substring({v}, p, n)))))"


def tokenlist(kind: str, source: str, tokens: str, low: str = "0", high: str = "0") -> X:
    return X(f"IF({source} IS NULL, NULL, named_struct('kind', '{kind}', 'source', {source}, 'tokens', {tokens}, 'nmin', cast({low} as int), 'nmax', cast({high} as int)))", "TOKENLIST")


def _source(x: X) -> str:
    return f"array_join({x.sql}, ' ')" if is_array(x.type) else cast(x, "STRING")


@fn("TOKEN", 1)
def _token(c, a):
    values = f"filter(transform({a[0].sql}, e -> lower(e)), e -> e IS NOT NULL)" if is_array(a[0].type) else f"array(lower({cast(a[0], 'STRING')}))"
    return tokenlist("token", _source(a[0]), values)


@fn("TOKENIZE_FULLTEXT", 1, 9)
def _fulltext(c, a):
    s = _source(a[0])
    return tokenlist("fulltext", s, f"array_distinct({words_sql(s)})")


def _sizes(c, a):
    low = c.named.get("ngram_size_min", a[1] if len(a) > 1 else X("1", "INT64")).sql
    high = c.named.get("ngram_size_max", a[2] if len(a) > 2 else X("4", "INT64")).sql
    return f"cast({low} as int)", f"cast({high} as int)"


@fn("TOKENIZE_SUBSTRING", 1, 9)
def _substring(c, a):
    s, (low, high) = _source(a[0]), _sizes(c, a)
    w = words_sql(s)
    return tokenlist("substring", s, f"array_distinct(concat({w}, flatten(transform({w}, w -> {grams_sql('w', low, high)}))))", low, high)


@fn("TOKENIZE_NGRAMS", 1, 9)
def _ngrams(c, a):
    s, (low, high) = _source(a[0]), _sizes(c, a)
    return tokenlist("ngrams", s, f"array_distinct({grams_sql(f'lower({s})', low, high)})", low, high)


@fn("TOKENIZE_NUMBER", 1, 9)
def _number(c, a):
    if is_array(a[0].type):
        return tokenlist("number", f"array_join(transform({a[0].sql}, e -> cast(e as string)), ' ')", f"transform({a[0].sql}, e -> cast(cast(e as double) as string))")
    return tokenlist("number", f"cast({a[0].sql} as string)", f"array(cast(cast({a[0].sql} as double) as string))")


@fn("TOKENIZE_BOOL", 1, 9)
def _bool(c, a):
    one = lambda v: f"IF({v}, 'y', 'n')"
    if is_array(a[0].type):
        return tokenlist("bool", f"array_join(transform({a[0].sql}, e -> cast(e as string)), ' ')", f"transform({a[0].sql}, e -> {one('e')})")
    return tokenlist("bool", f"cast({a[0].sql} as string)", f"array({one(a[0].sql)})")


@fn("TOKENIZE_JSON", 1, 9)
def _json(c, a):
    return tokenlist("json", cast(a[0], "STRING"), f"{c.udf('json_tokens')}({a[0].sql})")


@fn("TOKENLIST_CONCAT", 1, 99)
def _concat(c, a):
    lists = f"filter({a[0].sql}, e -> e IS NOT NULL)" if len(a) == 1 and is_array(a[0].type) else f"filter(array({', '.join(x.sql for x in a)}), e -> e IS NOT NULL)"
    source = f"IF(size({lists}) = 0, NULL, array_join(transform({lists}, e -> e.source), ' '))"
    return X(f"IF({source} IS NULL, NULL, named_struct('kind', get({lists}, 0).kind, 'source', {source}, 'tokens', array_distinct(flatten(transform({lists}, e -> e.tokens))), 'nmin', get({lists}, 0).nmin, 'nmax', get({lists}, 0).nmax))", "TOKENLIST")


def bound(t: str, body) -> str:
    """body(t) with t computed once, however often body has it; columns stand for themselves."""
    if re.fullmatch(r"[\w.`]+", t):
        return body(t)
    return f"get(transform(array({t}), lq_t -> {body('lq_t')}), 0)"


def _literal(x: X, name: str) -> str:
    if not x.lit or not isinstance(x.lit[0], str):
        raise Unimplemented(f"the query of {name} must be a literal")
    return x.lit[0]


def _words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^\w\s#]", "", text).lower().split() if w]


def _has(t: str, word: str) -> str:
    return f"array_contains({t}.tokens, {q(word)})"


def _phrase(t: str, text: str) -> str:
    return f"contains(concat(' ', array_join({words_sql(t + '.source')}, ' '), ' '), {q(' ' + ' '.join(_words(text)) + ' ')})"


def rquery(t: str, text: str) -> str:
    """The condition of an rquery: words are ANDed, OR and | bind alternatives, - negates, quotes make phrases."""
    joined, pending = [], False
    for m in re.finditer(r'(-?)"([^"]*)"|(\||\bOR\b)|(-?)([^\s"|]+)', text):
        if m[3]:
            pending = True
            continue
        if m[2] is not None:
            one, no = _phrase(t, m[2]), m[1]
        else:
            ws = _words(m[5])
            if not ws:
                continue
            one, no = " AND ".join(_has(t, w) for w in ws), m[4]
        one = f"NOT ({one})" if no else f"({one})"
        if pending and joined:
            joined[-1] = f"({joined[-1]} OR {one})"
        else:
            joined.append(one)
        pending = False
    return " AND ".join(joined) or "false"


@fn("SEARCH", 2, 9)
def _search(c, a):
    dialect = c.named.get("dialect")
    kind = dialect.lit[0] if dialect is not None and dialect.lit else "rquery"
    if not a[1].lit:
        t = a[0].sql
        return X(f"{c.udf('search')}(array_join({t}.tokens, '\\n'), {t}.source, {a[1].sql}, {q(kind)})", "BOOL")
    text = _literal(a[1], "SEARCH")
    body = {"rquery": lambda t: rquery(t, text), "words": lambda t: " AND ".join(_has(t, w) for w in _words(text)) or "false", "words_phrase": lambda t: _phrase(t, text)}.get(kind)
    if not body:
        raise InvalidArgument(f"unknown dialect {kind}")
    return X(bound(a[0].sql, lambda t: f"IF({t} IS NULL, NULL, {body(t)})"), "BOOL")


@fn("SEARCH_SUBSTRING", 2, 9)
def _search_substring(c, a):
    t = a[0].sql
    kind = c.named.get("relative_search_type")
    kind = kind.lit[0] if kind is not None and kind.lit else None
    source = f"lower({t}.source)"
    w = words_sql(f"{t}.source")
    if not a[1].lit:
        v, ws = f"lower({a[1].sql})", words_sql(a[1].sql)
        forms = {
            None: f"size({ws}) > 0 AND forall({ws}, x -> contains({source}, x))", "value_prefix": f"startswith({source}, {v})", "value_suffix": f"endswith({source}, {v})", "phrase": f"contains({source}, {v})",
            "word_prefix": f"size({ws}) > 0 AND forall({ws}, x -> exists({w}, y -> startswith(y, x)))", "word_suffix": f"size({ws}) > 0 AND forall({ws}, x -> exists({w}, y -> endswith(y, x)))",
        }
        if kind not in forms:
            raise InvalidArgument(f"unknown relative_search_type {kind}")
        return X(f"IF({t} IS NULL OR {v} IS NULL, NULL, {forms[kind]})", "BOOL")
    text = _literal(a[1], "SEARCH_SUBSTRING").lower()
    ws = _words(text)
    if kind == "value_prefix":
        body = f"startswith({source}, {q(text)})"
    elif kind == "value_suffix":
        body = f"endswith({source}, {q(text)})"
    elif kind == "phrase":
        body = f"contains({source}, {q(text)})"
    elif kind in ("word_prefix", "word_suffix"):
        f = "startswith" if kind == "word_prefix" else "endswith"
        body = " AND ".join(f"exists({w}, w -> {f}(w, {q(x)}))" for x in ws)
    elif kind is None:
        body = " AND ".join(f"contains({source}, {q(x)})" for x in ws)
    else:
        raise InvalidArgument(f"unknown relative_search_type {kind}")
    return X(f"IF({t} IS NULL, NULL, {body or 'false'})", "BOOL")


@fn("SEARCH_NGRAMS", 2, 9)
def _search_ngrams(c, a):
    t, v = a[0].sql, f"lower({cast(a[1], 'STRING')})"
    grams = f"array_distinct({grams_sql(v, f'greatest({t}.nmin, 1)', f'greatest({t}.nmax, 1)')})"
    least = c.named.get("min_ngrams")
    need = f"least({least.sql if least is not None else 2}, greatest(size({grams}), 1))" if least is None else least.sql
    if (p := c.named.get("min_ngrams_percent")) is not None:
        need = f"greatest({need}, ceil(size({grams}) * {p.sql} / 100D))"
    return X(f"IF({t} IS NULL OR {v} IS NULL, NULL, size(array_intersect({t}.tokens, {grams})) >= {need})", "BOOL")


@fn("SCORE", 2, 9)
def _score(c, a):
    t = a[0].sql
    w = words_sql(f"{t}.source")
    if not a[1].lit:
        ws = words_sql(a[1].sql)
        line = f"concat(' ', array_join({w}, ' '), ' ')"
        single = f"transform({ws}, x -> IF(array_contains({w}, x), 1D + ln(size(filter({w}, e -> e = x))), 0D))"
        pair = f"transform({ws}, (x, i) -> IF(i > 0 AND contains({line}, concat(' ', get({ws}, i - 1), ' ', x, ' ')), 2D, 0D))"
        return X(f"IF({t} IS NULL OR coalesce(size({ws}), 0) <= 0, 0D, aggregate(concat({single}, {pair}), 0D, (s, v) -> s + v) / size({ws}))", "FLOAT64")
    ws = _words(_literal(a[1], "SCORE"))
    if not ws:
        return X("0D", "FLOAT64")
    count = lambda x: f"size(filter({w}, e -> e = {q(x)}))"
    parts = [f"IF({count(x)} > 0, 1D + ln({count(x)}), 0D)" for x in ws]
    line = f"concat(' ', array_join({w}, ' '), ' ')"
    parts += [f"IF(contains({line}, {q(f' {x} {y} ')}), 2D, 0D)" for x, y in zip(ws, ws[1:], strict=False)]
    return X(f"IF({t} IS NULL, 0D, ({' + '.join(parts)}) / {len(ws)})", "FLOAT64")


@fn("SCORE_NGRAMS", 2, 9)
def _score_ngrams(c, a):
    t, v = a[0].sql, f"lower({cast(a[1], 'STRING')})"
    x, y = (f"array_distinct({grams_sql(s, '3', '3')})" for s in (f"lower({t}.source)", v))
    return X(f"IF({t} IS NULL OR {v} IS NULL OR size(array_union({x}, {y})) = 0, 0D, size(array_intersect({x}, {y})) / cast(size(array_union({x}, {y})) as double))", "FLOAT64")


@fn("SNIPPET", 2, 9)
def _snippet(c, a):
    width = c.named.get("max_snippet_width", X("200", "INT64")).sql
    many = c.named.get("max_snippets", X("1", "INT64")).sql
    return X(f"{c.udf('snippet')}({a[0].sql}, {a[1].sql}, cast({width} as bigint), cast({many} as bigint))", "JSON")


@fn("DEBUG_TOKENLIST", 1)
def _debug(c, a):
    return X(f"array_join(array_sort({a[0].sql}.tokens), ', ')", "STRING")
