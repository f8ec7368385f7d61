"""Conditional functions."""

from .base import X, cast, fn, unify


@fn("COALESCE", 1, 99)
def _coalesce(c, a):
    sql, t = unify(a)
    return X(f"coalesce({', '.join(sql)})", t)


@fn("IFNULL", 2)
def _ifnull(c, a):
    return _coalesce(c, a)


@fn("NULLIF", 2)
def _nullif(c, a):
    sql, t = unify(a)
    return X(f"CASE WHEN {c.compare_sql('=', X(sql[0], t), X(sql[1], t))} THEN NULL ELSE {sql[0]} END", t)


@fn("IF", 3)
def _if(c, a):
    sql, t = unify(a[1:])
    return X(f"IF({a[0].sql}, {sql[0]}, {sql[1]})", t)


@fn("ERROR", 1)
def _error(c, a):
    return X(f"raise_error({cast(a[0], 'STRING')})", "NULL")
