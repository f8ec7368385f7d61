"""Operator 2: licence scan by canonical digest lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small
from .licence_texts import LICENCES, SAME, TITLES

# Each step is a pattern and what replaces it, in the syntax that Java, RE2 and Python share.
_TITLE = "|".join(re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() for t in sorted(TITLES, key=len, reverse=True))
STEPS = [
    (r"(?m)^[ \t]*(?://+|#+|\*+|/\*+|;+|--|rem |dnl )[ \t]?", ""),
    (r"(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©)[^\n]*$", " "),
    (r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", " "),
    (r"[^a-z0-9]+", " "),
    (r"^ +| +$", ""),
]
HEAD = r"^(?:" + _TITLE + r") "


def _same() -> list[tuple[str, str]]:
    return [(rf"\b{a}\b", b) for a, b in SAME.items() if a != b] + [(r"\bnon (commercial|infringement)\b", r"non\1"), (r"\bsub licens", "sublicens"), (r"\bcopyright (holders|owners|owner)\b", "copyright holder"), (r"\b(holder|author)s\b", r"\1")]


def canonical_text(text: str) -> str:
    """What texts are compared by: see canonical()."""
    text = text.lower()
    for pattern, to in STEPS:
        text = re.sub(pattern, to, text)
    text = re.sub(HEAD, "", text)
    for pattern, to in _same():
        text = re.sub(pattern, to, text)
    return text


def canonical(text: Column) -> Column:
    """Lower case without comment signs, copyright lines, titles and punctuation, equivalent spellings made one, for texts of any length.

    One pattern first tells whether a text has any of the spellings; the steps that make them one leave all others as they are.
    """
    c = F.lower(text)
    for pattern, to in STEPS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    c = F.regexp_replace(c, F.lit(HEAD), F.lit(""))
    rest = c
    for pattern, to in _same():
        rest = F.regexp_replace(rest, F.lit(pattern), F.lit(to.replace(r"\1", "$1")))
    return F.when(c.rlike(r"\b(?:" + "|".join(p.removeprefix(r"\b") for p, _ in _same()) + ")"), rest).otherwise(c)


def known(spark, texts: dict[str, str] = LICENCES) -> DataFrame:
    """(digest, licence) of licence texts; texts that are the same in canonical form keep the first name."""
    rows: dict[str, str] = {}
    for name, text in sorted(texts.items()):
        rows.setdefault(canonical_text(text), name)
    d = spark.createDataFrame([(k, v) for k, v in rows.items()] or [("", "")], "text string, licence string")
    return d.where("text <> ''").select(F.sha2("text", 256).alias("digest"), "licence")


def licence_scan(docs: DataFrame, texts: dict[str, str] = LICENCES) -> DataFrame:
    """(doc_id, digest, licence) of all docs (doc_id, text): licence names the known text that a whole document is.

    digest is the SHA-256 of the canonical text, whatever its length. licence is null for other documents, as for null and
    empty texts, whose digest is that of no text. Rows are treated one by one, repeated rows each for itself, and an empty
    table gives no rows; only doc_id and text are read, so other columns may have any names. The known digests, a table of
    fixed size, are broadcast once counted.
    """
    d = docs.select("doc_id", F.sha2(F.coalesce(canonical(F.col("text")), F.lit("")), 256).alias("digest"))
    return d.join(small(known(docs.sparkSession, texts)), "digest", "left").select("doc_id", "digest", "licence")


def op2_licence_scan(spark, sf_dir: str) -> DataFrame:
    """The licence, if any, that each whole document is."""
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    c = "lower(text)"
    for pattern, to in STEPS:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    c = f"regexp_replace({c}, {q(HEAD)}, '', 'g')"
    same = "c"
    for pattern, to in _same():
        same = f"regexp_replace({same}, {q(pattern)}, {q(to)}, 'g')"
    values = ", ".join(f"({q(canonical_text(t))}, {q(n)})" for n, t in sorted(LICENCES.items()))
    return f"""with a as (select doc_id, {c} as c from documents), b as (select doc_id, {same} as c from a),
known(t, licence) as (values {values}), k as (select sha256(t) as digest, min(licence) as licence from known group by 1)
select doc_id, sha256(coalesce(c, '')) as digest, licence from b left join k on k.digest = sha256(coalesce(b.c, ''))"""


ORACLE = _sql()
