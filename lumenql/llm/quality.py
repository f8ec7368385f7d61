"""Operator 7: quality classifier, a sparse rule ensemble over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, arrow_batches, land, small, small_batches
from .textvec import LOWER, U, mix, parts, prefix, spans, window_hashes, words

#: Most labelled rows that a model is fitted on, those with the least hash of doc_id.
SAMPLE = 12_000
TREES, DEPTH, BINS = 40, 3, 48
#: Most rules that a model keeps.
RULES = 48


def _marks(values) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(values)] = 1
    return out


_CLASSES = {
    "upper": _marks(range(65, 91)),
    "lower": _marks(range(97, 123)),
    "digit": _marks(range(48, 58)),
    "space": _marks([9, 10, 11, 12, 13, 32]),
    "stop": _marks(b".?!"),
    "bang": _marks(b"!"),
    "comma": _marks(b",;:"),
    "symbol": _marks(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "pipe": _marks(b"|"),
    "bracket": _marks(b"()[]{}<>"),
    "wide": _marks(range(128, 256)),
}
STATISTICS = [
    "log_bytes", "log_words", *[f"{x}_share" for x in _CLASSES], "word_length", "long_words", "short_words", "capital_words", "caps_words", "symbol_words", "distinct_words",
    "distinct_trigrams", "log_lines", "line_words", "repeated_lines", "closed_lines", "doubled_signs", "byte_entropy",
]


def _between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring positions of at."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[at])


def _distinct(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct values between neighbouring positions of at."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    both = np.unique(mix(h ^ mix(owner.astype(U) + U(77))) >> U(24) << U(24) | owner.astype(U))
    return np.bincount((both & U((1 << 24) - 1)).astype(np.int64), minlength=len(at) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS a text, over the whole text; all zero but shares' defaults for empty ones."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    safe = np.maximum(size, 1)
    out = {"log_bytes": np.log1p(size)}
    for k, marks in _CLASSES.items():
        out[f"{k}_share"] = _between(marks[data], offsets) / safe
    start, end, first = words(data, offsets)
    count = np.diff(first)
    w = np.maximum(count, 1)
    length = end - start
    sums = prefix(LOWER[data])
    h = mix(spans(sums, start, end) + length.astype(U))
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASSES["upper"][data], out=upper[1:])
    lower = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASSES["lower"][data], out=lower[1:])
    symbol = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASSES["symbol"][data], out=symbol[1:])
    ups, lows = upper[end] - upper[start], lower[end] - lower[start]
    share = lambda x: _between(x.astype(np.int64), first) / w
    out["log_words"] = np.log1p(count)
    out["word_length"] = _between(length, first) / w
    out["long_words"], out["short_words"] = share(length > 12), share(length <= 2)
    out["capital_words"] = share((ups == 1) & (lows > 0))
    out["caps_words"] = share((ups > 1) & (lows == 0))
    out["symbol_words"] = share(symbol[end] - symbol[start] > 0)
    out["distinct_words"] = _distinct(h, first) / w
    grams = window_hashes(h, 3)
    lo, hi = np.minimum(first[:-1], len(grams)), np.minimum(np.maximum(first[1:] - 2, first[:-1]), len(grams))
    tri = np.maximum(hi - lo, 0)
    at = np.concatenate([[0], np.cumsum(tri)])
    pick = np.arange(at[-1]) - np.repeat(at[:-1] - lo, tri)
    out["distinct_trigrams"] = np.where(tri > 0, _distinct(grams[pick], at) / np.maximum(tri, 1), 1.0)
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[1:] |= data == 10
        cut = np.flatnonzero(edge)
        a, b = cut[:-1], cut[1:]
        b = b - (data[b - 1] == 10)
        ok = b > a
        a, b = a[ok], b[ok]
        lines = np.searchsorted(a, offsets)
        hl = mix(spans(sums, a, b) + (b - a).astype(U))
        closed = _CLASSES["stop"][data[b - 1]]
    else:
        lines, hl, closed = np.zeros(n + 1, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    k = np.diff(lines)
    kk = np.maximum(k, 1)
    out["log_lines"] = np.log1p(k)
    out["line_words"] = np.log1p(count / kk)
    out["repeated_lines"] = np.where(k > 0, 1 - _distinct(hl, lines) / kk, 0.0)
    out["closed_lines"] = _between(closed, lines) / kk
    twice = np.zeros(len(data), np.int64)
    if len(data) > 1:
        sign = (_CLASSES["lower"] + _CLASSES["upper"] + _CLASSES["digit"] + _CLASSES["space"] + _CLASSES["wide"])[data] == 0
        twice[1:] = sign[1:] & (data[1:] == data[:-1])
    out["doubled_signs"] = _between(twice, offsets) / safe
    entropy = np.zeros(n)
    for i in range(n):
        c = np.bincount(data[offsets[i] : offsets[i + 1]])
        c = c[c > 0] / safe[i]
        entropy[i] = -(c * np.log2(c)).sum() if len(c) else 0.0
    out["byte_entropy"] = entropy
    return np.stack([np.asarray(out[x], np.float64) for x in STATISTICS], 1)


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) -> (doc_id, *STATISTICS), doc_id being the key; null text counts as empty."""
    columns = {"doc_id": pa.int64(), **{x: pa.float64() for x in STATISTICS}}

    def run(batches):
        def rows():
            for x in batches:
                for at, n, data, offsets in parts(x.column(1), 1_000_000):
                    s = statistics(data, offsets)
                    yield {"doc_id": x.column(0).slice(at, n), **{k: s[:, i] for i, k in enumerate(STATISTICS)}}

        return arrow_batches(rows(), columns)

    return docs.select(F.col(key).cast("bigint"), "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{x} double" for x in STATISTICS))


@dataclass
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold, or <= it."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.terms:
            v = x[:, names.index(name)]
            out &= (v > at) if above else (v <= at)
        return out

    def column(self) -> Column:
        out = None
        for name, above, at in self.terms:
            c = F.col(name) > at if above else F.col(name) <= at
            out = c if out is None else out & c
        return out


@dataclass
class Model:
    """A logistic score: intercept plus the weights of the rules that hold."""

    intercept: float
    rules: list[Rule]

    def score(self) -> Column:
        s = F.lit(self.intercept)
        for r in self.rules:
            s = s + F.when(r.column(), r.weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator) -> list[Rule]:
    """All paths of boosted regression trees on the logistic loss, as rules."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(f)], 1)  # value <= cuts[b] for bins up to b
    margin = np.full(n, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        use = rng.permutation(f)[: max(4, f // 2)]
        rows = np.flatnonzero(rng.random(n) < 0.6)
        todo = [(rows, np.arange(n), (), 0)]
        while todo:
            r, every, path, depth = todo.pop()
            value = g[r].sum() / (h[r].sum() + 1)
            best = (1e-3, None, None)
            if depth < DEPTH and len(r) >= 20:
                off = np.arange(len(use)) * (BINS + 1)
                at = (bins[np.ix_(r, use)] + off).ravel()
                gs, hs, cs = (np.bincount(at, np.repeat(w, len(use)), len(use) * (BINS + 1)).reshape(len(use), -1).cumsum(1) for w in (g[r], h[r], np.ones(len(r))))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(cs < 8) | (cs[:, -1:] - cs < 8)] = -1
                k = int(gain.argmax())
                if gain.ravel()[k] > best[0]:
                    best = (gain.ravel()[k], use[k // (BINS + 1)], k % (BINS + 1))
            if path:
                found.setdefault(tuple(sorted(path)), Rule(tuple((names[j], above, float(cuts[j][b])) for j, above, b in path)))
            if best[1] is None:
                margin[every] += 0.2 * value
                continue
            j, b = int(best[1]), int(best[2])
            for above in (False, True):
                todo.append((r[(bins[r, j] > b) == above], every[(bins[every, j] > b) == above], (*path, (j, above, b)), depth + 1))
    return list(found.values())


def lasso(z: np.ndarray, y: np.ndarray, strength: float, start: tuple[float, np.ndarray], rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic lasso by accelerated proximal gradient steps; the intercept is not penalised."""
    n, k = z.shape
    b0, b = start
    lip = 0.25 * (power_norm(z) / n + 1)
    v0, v, t = b0, b.copy(), 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-(z @ v + v0))) - y) / n
        nb0 = v0 - r.sum() / lip
        nb = v - (z.T @ r) / lip
        nb = np.sign(nb) * np.maximum(np.abs(nb) - strength / lip, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v0, v = nb0 + (t - 1) / nt * (nb0 - b0), nb + (t - 1) / nt * (nb - b)
        b0, b, t = nb0, nb, nt
    return b0, b


def power_norm(z: np.ndarray) -> float:
    v = np.ones(z.shape[1]) / np.sqrt(max(1, z.shape[1]))
    s = 1.0
    for _ in range(20):
        v = z.T @ (z @ v)
        s = np.linalg.norm(v) or 1.0
        v = v / s
    return float(s)


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = STATISTICS, seed: int = 7) -> Model:
    """A rule ensemble: paths of trees, weighted by the logistic lasso with the least strength that keeps at most RULES."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))), [])
    rules = grow_rules(x, y, names, np.random.default_rng(seed))
    z = np.stack([r.holds(x, names) for r in rules], 1).astype(np.float64)
    keep = (z.mean(0) > 0.002) & (z.mean(0) < 0.998)
    _, once = np.unique(mix(z.T.astype(np.int64).dot(np.arange(1, len(z) + 1) ** 2).view(U)), return_index=True)
    keep &= np.isin(np.arange(len(rules)), once)
    rules, z = [r for r, k in zip(rules, keep, strict=True) if k], z[:, keep]
    spread = np.maximum(z.std(0), 0.05)
    zs = z / spread
    now = (float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(rules)))
    top = np.abs(zs.T @ (y - y.mean())).max() / len(y)
    chosen = now
    for part in np.geomspace(0.3, 0.001, 12):
        now = lasso(zs, y, top * part, now)
        if (now[1] != 0).sum() > RULES:
            break
        chosen = now
    return Model(float(chosen[0]), [Rule(r.terms, float(w / s)) for r, w, s in zip(rules, chosen[1], spread, strict=True) if w])


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, __y) of at most `sample` labelled documents outside the held-out fold.

    Labels of one doc_id are averaged, null ones are left out. The sample, a documented bound on what the driver gets,
    is that of the least hashes of doc_id, so it is the same in each run.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("__y"))
    return known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train_rows(known: DataFrame) -> Model:
    """Fits a model on rows of (__y, *STATISTICS), as many as sampled() lets through."""
    rows = known.select("__y", *STATISTICS).toPandas().sort_values(["__y", *STATISTICS]).to_numpy().reshape(-1, len(STATISTICS) + 1)
    return fit(rows[:, 1:], (rows[:, 0] >= 0.5).astype(np.float64))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on the sampled labels' statistics."""
    return train_rows(stats.join(F.broadcast(sampled(labels, sample)), "doc_id"))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows without a doc_id count as held out.

    Each row is scored by its own whole text, repeated rows alike, null as empty; an empty table gives no rows. Only doc_id and text
    are read, so other columns may have any names.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return stats.select("doc_id", held.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns kept, without those that a model fitted on labels rejects (score below 0.3).

    Rows are told by (doc_id, text), so rows that share a doc_id are each judged by their own text and repeated rows stay or
    go together. Without labels all score alike and stay; an empty table gives no rows.
    """
    d = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    with small_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        stats = land(with_statistics(d.select("doc_id", "text", "__rid"), "__rid"), "stats")
    known = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__rid").alias("__key")).join(F.broadcast(sampled(labels)), "doc_id")
    model = train_rows(stats.join(small(known.select("__key", "__y")), F.col("doc_id") == F.col("__key")))
    bad = stats.select(F.col("doc_id").alias("__bad"), model.score().alias("__score")).where("__score < 0.3").select("__bad").distinct()
    return d.join(small(bad), F.col("__rid") == F.col("__bad"), "left_anti").drop("__rid")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fold."""
    stats = land(with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "stats")
    return scored(stats, train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
