"""Operator 6: removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_part, land, partitions, release, scratch, tidy
from .textvec import U, mix, parts, powers, prefix, spans

#: Bytes of the substrings whose least hash picks a window's anchor.
ANCHOR = 24
#: Distinct contexts of one anchor that one task takes (some 3 MB); more are split by _hot_ranges().
MOST_CONTEXTS = 12_000
#: Bytes of a text that positions in packed values can tell apart, and of a repeated string.
MOST_BYTES, MOST_LEAST = 1 << 28, 16_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, least: int):
    """(text, start, end, anchor, key, context hash) of the runs of windows of `least` bytes that have one anchor.

    A window's anchor is its substring of ANCHOR bytes with the least hash, the leftmost of equal ones, so equal
    windows have equal anchors wherever they stand. A run's context is all bytes of its windows.
    """
    size = np.diff(offsets)
    n = len(data)
    if n >= MOST_BYTES:
        raise ValueError(f"a text of {n} bytes is longer than {MOST_BYTES}")
    if n < least or not (size >= least).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    k = min(ANCHOR, least)
    sums = prefix(data)
    inverse = powers(n + 1)[1]
    gram = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    packed = (gram >> U(28) << U(28)) | np.arange(len(gram), dtype=U)
    at = (sliding_least(packed, least - k + 1) & U((1 << 28) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(size)), np.maximum(0, size - least + 1))
    start = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(0, size - least + 1)) - np.maximum(0, size - least + 1), np.maximum(0, size - least + 1)) + offsets[:-1][text]
    at = at[start]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    f = np.flatnonzero(first)
    last = np.append(f[1:], len(at)) - 1
    lo, hi = start[f], start[last] + least
    return text[f], lo, hi, at[f], gram[at[f]], mix(spans(sums, lo, hi) + (hi - lo).astype(U))


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of codes by at least their first depth values, by prefix doubling over suffixes not told apart yet."""
    n = len(codes)
    top = int(codes.max()) + 2
    width = min(n, max(1, int(62 / np.log2(top))))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key *= top
        key[: n - k] += codes[k:] + 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, key = np.arange(n), key[order]
    while True:
        # order[slots] is sorted by key: suffixes with equal keys get the first of their slots as rank
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[order[slots]] = slots[first][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if width >= depth or not len(slots):
            return order
        at = order[slots]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[slots] = at[by]
        key = key[by]
        width *= 2


def repeated_starts(codes: np.ndarray, least: int) -> np.ndarray:
    """Whether the string of `least` codes that starts at each position starts elsewhere too.

    codes: texts, each followed by a code that occurs nowhere else, so matches end with their text. The common prefixes
    of neighbours in suffix order are found by increasing value: all intervals of suffixes with one prefix of length l
    are extended backward by each code before them on the Burrows-Wheeler transform, which gives the intervals of
    length l + 1; a boundary that an interval sets for the first time has common prefix l. Only intervals with a new
    boundary go on, and the search stops at `least`: boundaries not set by then have a longer common prefix. The
    intervals of the first 16 lengths, which nearly all positions leave, come from comparing codes directly.
    """
    n = len(codes)
    order = suffix_order(codes, least)
    before = codes[order - 1]  # the transform; order - 1 is -1 for the first suffix, whose predecessor is the last code
    step = np.empty(n, np.int64)  # rank of the suffix one code longer
    by = np.argsort(before * n + np.arange(n))
    step[by] = np.arange(n)
    back = by  # rank of the suffix one code shorter, by rank
    start = min(16, least)
    prefixes = np.full(n, 0, np.int64)  # common prefix with the suffix before, up to start
    alike = np.arange(1, n)
    for k in range(start):
        x, y = order[alike] + k, order[alike - 1] + k
        same = (x < n) & (y < n)
        same[same] = codes[x[same]] == codes[y[same]]
        alike = alike[same]
        prefixes[alike] = k + 1
    edge = np.append(prefixes == 0, True)
    bound = np.append(prefixes < start, True)  # bound[p]: suffixes p - 1 and p differ within the length reached
    bound[0] = edge[0] = True
    new = np.flatnonzero(prefixes[1:] == start - 1) + 1
    for _ in range(start, least):
        if not len(new):
            break
        # an interval split at q: for each code before its suffixes, the first such at or behind q becomes a boundary if
        # one before q has the code: then its predecessor in rank is back[p - 1] < q
        ends = np.flatnonzero(bound)
        size = ends[np.searchsorted(ends, new, "right")] - new
        q = np.repeat(new, size)
        p = step[q + np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)]
        p = p[~bound[p] & (back[p - 1] < q)]
        new = np.unique(p)
        bound[new] = True
    out = np.zeros(n, bool)
    out[order] = ~(bound[:n] & bound[1:])
    return out


def repeated_windows(contexts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each context the merged byte ranges that strings of `least` bytes with another start among the contexts cover."""
    size = np.array([len(x) for x in contexts])
    total = int(size.sum()) + len(size)
    codes = np.empty(total, np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    codes[:] = text
    codes[begin[1:] - 1] = 256 + np.arange(len(size))
    hit = repeated_starts(codes, least)
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        out.append(merged(np.flatnonzero(hit[a : b - 1]), least))
    return out


def sharing(group: list[tuple], least: int) -> list[tuple]:
    """The contexts (.., bytes, before) of one anchor, which stands behind `before` bytes of its context, that may have a window in common.

    Equal windows agree on half of what they have beside the anchor at least, so on that many bytes right before the anchor
    or right after it. Without before all are kept.
    """
    if group[0][5] is None:
        return group
    k = min(ANCHOR, least)
    half = (least - k + 1) // 2
    sides = [(h[4][h[5] - half : h[5]] if h[5] >= half else None, h[4][h[5] + k : h[5] + k + half] if len(h[4]) >= h[5] + k + half else None) for h in group]
    left, right = (Counter(s[i] for s in sides if s[i] is not None) for i in (0, 1))
    return [h for h, (x, y) in zip(group, sides, strict=True) if left[x] > 1 or right[y] > 1]


def merged(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges that strings of `least` bytes at sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > least) + 1
    return [(int(x[0]), int(x[-1]) + least) for x in np.split(starts, cut)]


def identified(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text); rid, a hash of both, tells rows apart that share a doc_id."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def repeated_ranges(docs: DataFrame, least: int = 200) -> DataFrame:
    """(rid, spans array<struct<lo, hi>>) of rows of identified() with bytes in strings of `least` bytes that start twice.

    All windows with the same content have the same anchor (see anchors()), so they meet under its key. Runs whose whole context
    occurs twice are repeated as they are. For anchors with several contexts, one of each is taken to a task, which
    builds the transform of these contexts and expands intervals up to `least`. An anchor with more than MOST_CONTEXTS
    contexts (a passage that very many texts share ends in as many) is first split by _hot_ranges().
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("rid"), "text")

    def runs(batches):
        columns = {"rid": pa.int64(), "span": pa.int64(), "key": pa.int64(), "context": pa.int64()}

        def rows():
            for x in batches:
                for at, n, data, offsets in parts(x.column(1)):
                    text, lo, hi, anchor, key, context = anchors(data, offsets, least)
                    base = offsets[:-1][text]
                    span = ((lo - base) << 32) | ((hi - lo) << 16) | (anchor - lo)
                    yield {"rid": x.column(0).slice(at, n).take(pa.array(text)), "span": span, "key": key.view(np.int64), "context": context.view(np.int64)}

        return arrow_batches(rows(), columns)

    lo, hi, at = F.shiftright("span", 32).cast("int"), (F.shiftright("span", 32) + F.shiftright("span", 16).bitwiseAND(65535)).cast("int"), (F.shiftright("span", 32) + F.col("span").bitwiseAND(65535)).cast("int")
    run = land(docs.mapInArrow(runs, "rid bigint, span bigint, key bigint, context bigint"), "runs")
    contexts = land(run.groupBy("key", "context").agg(F.count("*").alias("n"), F.first("rid").alias("rid"), F.first("span").alias("span")), "contexts")
    tidy(spark)
    keys = contexts.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").drop("least")
    whole = land(run.join(contexts.where("n > 1").select("key", "context"), ["key", "context"], "left_semi").select("rid", lo.alias("lo"), hi.alias("hi")), "whole")
    release(run)
    wanted = contexts.join(keys, "key").groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("key", "m", "n", lo.alias("lo"), hi.alias("hi"), at.alias("at"))).alias("runs"))
    text = docs.join(wanted, F.col("rid") == F.col("__rid")).select("rid", F.encode(F.col("text"), "UTF-8").alias("bytes"), F.explode("runs").alias("r"))
    cut = land(text.select("rid", "r.*", F.substring("bytes", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo")).alias("bytes")), "cut")
    del text, wanted, keys
    release(contexts)

    def expand(batches):
        columns = {"rid": pa.int64(), "lo": pa.int32(), "hi": pa.int32()}

        def done(held):
            out = []
            for h, ranges in zip(held, repeated_windows([h[4] for h in held], least), strict=True):
                out += [(h[1], h[3] + a, h[3] + b) for a, b in ranges] if h[2] == 1 else []
            return {k: [r[i] for r in out] for i, k in enumerate(columns)}

        def rows():
            held, size = [], 0
            for group in by_part(batches):
                held += (group := sharing(group, least))
                size += sum(len(h[4]) for h in group)
                if size > 1_500_000:
                    yield done(held)
                    held, size = [], 0
            if held:
                yield done(held)

        return arrow_batches(rows(), columns)

    ranges = "rid bigint, lo int, hi int"
    dealt = cut.where(F.col("m") <= MOST_CONTEXTS).select("key", "rid", "n", "lo", "bytes", (F.col("at") - F.col("lo")).alias("before")).repartition(partitions(spark), "key").sortWithinPartitions("key")
    expanded = dealt.mapInArrow(expand, ranges)

    hot = cut.where(F.col("m") > MOST_CONTEXTS).drop("m")
    if hot.limit(1).count():
        expanded = expanded.union(_hot_ranges(hot, least, lambda rows: rows.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(expand, ranges)))
    return whole.union(expanded).distinct().groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _hot_ranges(hot: DataFrame, least: int, expand) -> DataFrame:
    """Repeated ranges of contexts whose anchor has very many.

    Windows are told by how many bytes they reach left of the anchor. All windows whose reach lies in a range have a core
    in common with the anchor in it, and equal windows have equal cores. So contexts are grouped by the core's hash, for
    ranges that are halved from step to step: a context alone in its group has no repeated window there, a group of at
    most MOST_CONTEXTS goes to expand(), a larger one is halved again, down to groups of one window. A context takes part
    in a few ranges a step, so rows grow in proportion to the contexts.
    """
    k = min(ANCHOR, least)
    most = least - k
    size = 1 << max(0, most.bit_length() - 1)
    fields = "key bigint, rid bigint, n bigint, lo int, hi int, at int, bytes binary, low int, size int, grp bigint"
    columns = {"key": pa.int64(), "rid": pa.int64(), "n": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "at": pa.int32(), "bytes": pa.binary(), "low": pa.int32(), "size": pa.int32(), "grp": pa.int64()}
    names = list(columns)

    def cores(batches):
        def rows():
            for x in batches:
                out = []
                for key, rid, n, lo, hi, at, data, low, size in zip(*[c.to_pylist() for c in x.columns], strict=True):
                    a, b = max(low, at - (hi - least)), min(low + size - 1, at - lo)
                    if a > b:
                        continue
                    core = data[at - low - lo : at + k + max(0, most - low - size + 1) - lo]
                    group = int.from_bytes(hashlib.blake2b(core + b"%d %d %d" % (key, low, size), digest_size=8).digest(), "little", signed=True)
                    part = data[at - b - lo : at - a + least - lo]
                    out.append((key, rid, n, at - b, at - a + least, at, part, low, size, group))
                yield {c: [r[i] for r in out] for i, c in enumerate(names)}

        return arrow_batches(rows(), columns)

    found = []
    front = hot.select("key", "rid", "n", "lo", "hi", "at", "bytes", F.explode(F.sequence(F.lit(0), F.lit(most), F.lit(size))).alias("low"), F.lit(size).alias("size"))
    while True:
        front = land(front.mapInArrow(cores, fields), "cores")
        groups = land(front.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1"), "groups")
        both = front.join(groups, "grp")
        if size == 1:
            found.append(both.where("n = 1").select("rid", "lo", "hi"))
            break
        found.append(expand(both.where(F.col("m") <= MOST_CONTEXTS).select(F.col("grp").alias("key"), "rid", "n", "lo", "bytes", F.lit(None).cast("int").alias("before"))))
        if not groups.where(F.col("m") > MOST_CONTEXTS).limit(1).count():
            break
        size //= 2
        front = both.where(F.col("m") > MOST_CONTEXTS).select("key", "rid", "n", "lo", "hi", "at", "bytes", F.explode(F.array(F.col("low"), (F.col("low") + size).cast("int"))).alias("low"), F.lit(size).alias("size"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def remove_repeats(docs: DataFrame, least: int = 200, with_text: bool = False) -> DataFrame:
    """One row a document (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.

    A byte goes if a string of `least` bytes over it also starts anywhere else, in any text or the same one; all copies
    go. Texts are UTF-8 bytes, null as empty (kept_sha256 of nothing, no span), and matches end with their text. Rows
    with one doc_id are each treated for themselves; an empty table gives no rows, and other columns are not read. Exact but
    for collisions of 64-bit hashes. A text of over MOST_BYTES, or least over MOST_LEAST, raises an error.

    Strings that recur with all that surrounds them (whole copies) are told by hashes of runs of windows; the transform
    decides on all others, that is wherever a passage stands in different surroundings.
    """
    if least > MOST_LEAST:
        raise ValueError(f"strings of more than {MOST_LEAST} bytes are not supported")
    d = identified(docs)
    with scratch(docs.sparkSession) as keep:
        found = keep(repeated_ranges(d, least), "repeats").withColumnRenamed("rid", "__rid")
    d = d.join(found, F.col("rid") == F.col("__rid"), "left").select("doc_id", "text", "spans")

    def kept(batches):
        columns = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}

        def rows():
            for x in batches:
                out = []
                for d, text, found in zip(*[c.to_pylist() for c in x.columns], strict=True):
                    data = (text or "").encode()
                    end, n, left = 0, 0, []
                    edge = 0
                    for s in sorted((s["lo"], s["hi"]) for s in found or ()):
                        if s[0] > edge or not n:
                            left.append(data[edge : s[0]])
                            n += 1
                        edge = max(edge, s[1])
                        end = edge
                    left.append(data[end:])
                    rest = b"".join(left)
                    out.append((d, len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
                yield {k: [r[i] for r in out] for i, k in enumerate(columns)}

        return arrow_batches(rows(), columns)

    out = d.mapInArrow(kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that start twice."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 200)
