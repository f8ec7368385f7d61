"""Operator 4: substring dedup by paragraph MinHash banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, land, parts_for, scratch, small, tidy
from .jaccard_join import PACKED, in_chunks, link_blocks, meet, pack
from .suffix_dedup import sliding_least
from .textvec import LOWER, U, mix, parts, window_hashes, word_hashes, words

#: Words of a shingle, and the similarity as a fraction.
WIDTH, NUM, DEN = 5, 4, 5
#: A paragraph is cut where a word pair's hash is the least of so many on either side.
RADIUS = 6
#: Words that a paragraph, and a run of repeated paragraphs, must have.
LEAST_WORDS, LEAST_RUN = 7, 16
#: MinHash values that make a band's key.
ROWS = 2
#: MinHash keys that a task packs before it sends them on.
HELD = 1_500_000


def bands(similarity: float, recall: float = 0.99, rows: int = 1) -> int:
    """Bands of so many rows with which pairs at the similarity collide with the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def paragraphs(data: np.ndarray, offsets: np.ndarray):
    """(text, first word, last word + 1) of paragraphs, and start, end and hash of words.

    A line of LEAST_WORDS words or more is a block; shorter lines that follow each other make one together. In a block a
    cut stands before each word whose pair with the next has the least hash of its neighbourhood, and where a run of
    LEAST_WORDS times one word begins and ends. Cuts of the first kind that leave less than LEAST_WORDS words are left
    out. Cuts depend on the words around them in the block only, so a passage is cut alike wherever it stands in one.
    """
    start, end, first = words(data, offsets)
    h = word_hashes(LOWER[data], start, end)
    n = len(start)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, start, end, h
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.zeros(n, bool)
    opens[first[:-1][first[:-1] < n]] = True
    line = opens.copy()
    line[1:] |= lines[start[1:]] > lines[end[:-1]]
    at = np.flatnonzero(line)
    short = np.diff(np.append(at, n)) < LEAST_WORDS
    block = at[opens[at] | ~short | ~np.append(False, short[:-1])]
    own = np.searchsorted(block, np.arange(n), "right") - 1
    pair = np.full(n, ~U(0))
    pair[:-1] = window_hashes(h, 2)
    pair[block[1:] - 1] = ~U(0)  # pairs across blocks
    place = np.arange(n) + RADIUS * own
    full = np.full(n + RADIUS * (len(block) + 1), ~U(0))
    full[place + RADIUS] = pair
    least = sliding_least(full, 2 * RADIUS + 1)[place]
    before = sliding_least(full, RADIUS)[place]  # of the RADIUS pairs before
    same = np.zeros(n + 3, bool)  # same[i]: pairs i and i + 1 are equal, so a word is said three times
    same[: n - 1] = (pair[1:] == pair[:-1]) & (pair[1:] != ~U(0))
    begins = np.flatnonzero(same[:n] & same[1 : n + 1] & ~np.append(False, same[: n - 1]))
    ends = np.flatnonzero(same[:n] & same[1 : n + 1] & ~same[2 : n + 2]) + 4
    long = ends - begins >= LEAST_WORDS
    hard = np.unique(np.concatenate([block, begins[long], ends[long], [n]]))
    cut = np.flatnonzero((pair == least) & (pair < before) & (pair != ~U(0)))
    to = np.searchsorted(hard, cut, "right")
    cut = cut[(cut - hard[to - 1] >= LEAST_WORDS) & (hard[to] - cut >= LEAST_WORDS)]
    a = np.union1d(hard[:-1], cut)
    b = np.append(a[1:], n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[a]
    return text, a, b, start, end, h


def shingled(h: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(shingle hashes, bounds) of word runs a to b; runs have at least WIDTH words."""
    grams = window_hashes(h, WIDTH)
    size = b - a - WIDTH + 1
    at = np.concatenate([[0], np.cumsum(size)])
    return grams[np.arange(at[-1]) - np.repeat(at[:-1] - a, size)], at


def repeated_paragraphs(docs: DataFrame, recall: float = 0.99, least_run: int = LEAST_RUN, across: bool = True) -> DataFrame:
    """(doc_id, mark, lo, hi, words, cluster, removed): runs of paragraphs of docs (doc_id, text) that repeat.

    Paragraphs of LEAST_WORDS words or more (all but single short lines between long ones, and words beside a run of one
    word) are grouped by their set of WIDTH-word shingles. Sets that collide in a band
    of MinHash values, as many bands as the recall at the similarity NUM/DEN asks for, are joined: inside the connected
    blocks of collisions exact Jaccard is computed by link_blocks(), which loses no link there. Components of links are
    clusters; the first paragraph of a cluster by (doc_id, position) stays, all others are removals. Neighbouring
    paragraphs of clusters with several members, at most one other between two, make a run, which counts from least_run words; lo and hi are its UTF-8
    bytes, cluster is that of its first paragraph, removed is how many of its words are removals. With across only
    clusters of several doc_ids count, not those of repeats inside one document.

    Words are lower-cased for A to Z. Null, empty and short texts have no paragraphs. mark is xxhash64(text), which tells
    rows with one doc_id apart; rows equal in both are one.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_passages(docs, recall, least_run, across), "passages")


def _passages(docs: DataFrame, recall: float, least_run: int, across: bool) -> DataFrame:
    spark = docs.sparkSession
    count, many = parts_for(docs), bands(NUM / DEN, recall, ROWS)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("mark", F.xxhash64("text"))
    seeds = mix(np.arange(1, many * ROWS + 1, dtype=U))

    def compared(data, offsets):
        text, a, b, start, end, h = paragraphs(data, offsets)
        ok = b - a >= LEAST_WORDS
        return text[ok], a[ok], b[ok], start, end, h

    def cut(batches):
        columns = {"doc_id": pa.int64(), "mark": pa.int64(), "i": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "words": pa.int32(), "cls": pa.int64()}

        def rows():
            for x in batches:
                for at, n, data, offsets in parts(x.column(1), 500_000):
                    text, a, b, start, end, h = compared(data, offsets)
                    i = np.arange(len(a)) - np.searchsorted(text, text)
                    cls, _ = classes(*shingled(h, a, b))
                    take, base = pa.array(text), offsets[:-1][text]
                    yield {
                        "doc_id": x.column(0).slice(at, n).take(take), "mark": x.column(2).slice(at, n).take(take), "i": i.astype(np.int32), "lo": (start[a] - base).astype(np.int32),
                        "hi": (end[b - 1] - base).astype(np.int32), "words": (b - a).astype(np.int32), "cls": cls,
                    }

        return arrow_batches(rows(), columns)

    def signed(batches):
        """Packed keys of the bands of distinct sets: what the minima of a band's ROWS hash functions give together."""
        keys, nodes, held = [], [], 0

        def flush():
            yield from pack(np.concatenate(keys), np.concatenate(nodes), count)
            keys.clear()
            nodes.clear()

        def rows():
            nonlocal held
            for x in batches:
                for _, _, data, offsets in parts(x.column(0), 500_000):
                    _, a, b, _, _, h = compared(data, offsets)
                    cls, low = classes(*shingled(h, a, b), seeds)
                    cls, one = np.unique(cls, return_index=True)
                    if not len(cls):
                        continue
                    low = low[:, one].reshape(many, ROWS, -1)
                    key = np.broadcast_to(np.arange(many, dtype=U)[:, None], (many, len(cls)))
                    for k in range(ROWS):
                        key = mix(key * U(0x9E3779B97F4A7C15) + low[:, k])
                    keys.append(key.ravel())
                    nodes.append(np.tile(cls, many))
                    held += key.size
                if held > HELD:
                    yield from flush()
                    held = 0
            if keys:
                yield from flush()

        return arrow_batches(rows(), PACKED)

    found = land(docs.mapInArrow(cut, "doc_id bigint, mark bigint, i int, lo int, hi int, words int, cls bigint"), "paragraphs")
    groups = meet(docs.select("text").mapInArrow(signed, "part int, keys binary, nodes binary, sizes binary"), count)
    tidy(spark)
    # these joins are plain ones, which adaptive execution turns into broadcasts or splits as it sees fit, so they work alike at every size
    nodes = groups.select(F.col("node").alias("cls"), F.lit(True).alias("met")).distinct()
    each = found.groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "lo", "hi", "words", "i")).alias("one"), F.max("doc_id").alias("last"))
    each = land(each.join(nodes, "cls", "left").where("n > 1 or met"), "classes")
    ones = in_chunks(groups.select(F.col("node").alias("cls"), F.col("grp").alias("block")).join(each.where("met"), "cls").select("cls", "block", "one.doc_id", "one.mark", "one.lo", "one.hi", F.col("one.words").alias("n")))
    wanted = ones.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("cls", "block", "chunk", "chunks", "lo", "hi")).alias("runs"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))).select(F.encode(F.col("text"), "UTF-8").alias("data"), F.explode("runs").alias("r"))
    texts = texts.select("r.cls", "r.block", "r.chunk", "r.chunks", F.substring("data", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo")).alias("data"))

    def sets(batches):
        columns = {"cls": pa.int64(), "block": pa.int64(), "chunk": pa.int64(), "chunks": pa.int64(), "data": pa.binary()}

        def rows():
            for x in batches:
                for at, n, data, offsets in parts(x.column(4)):
                    start, end, first = words(data, offsets)
                    grams, bounds = shingled(word_hashes(LOWER[data], start, end), first[:-1], first[1:])
                    yield {k: x.column(i).slice(at, n) for i, k in enumerate(columns)} | {"data": [np.unique(grams[bounds[k] : bounds[k + 1]]).tobytes() for k in range(n)]}

        return arrow_batches(rows(), columns)

    members = land(texts.mapInArrow(sets, "cls bigint, block bigint, chunk bigint, chunks bigint, data binary"), "members")
    links = link_blocks(members, NUM, DEN)
    roots = components(links)
    each = each.alias("e").join(small(roots).alias("r"), F.col("e.cls") == F.col("r.node"), "left").select("e.cls", "n", "one", "last", F.coalesce("root", "e.cls").alias("root"))
    clusters = each.groupBy("root").agg(F.sum("n").alias("n"), F.min(F.struct("one.doc_id", "one.mark", "one.i")).alias("top"), F.max("last").alias("last")).where((F.col("n") > 1) & (~F.col("last").eqNullSafe(F.col("top.doc_id")) | F.lit(not across)))
    each = land(each.join(small(clusters.select("root", "top")), "root").select("cls", F.col("root").alias("cluster"), "top"), "clusters")
    hits = found.join(each, "cls").withColumn("removed", ~F.struct("doc_id", "mark", "i").eqNullSafe(F.struct("top.doc_id", "top.mark", "top.i")))
    runs = hits.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("i", "lo", "hi", "words", "cluster", "removed"))).alias("hits"))
    empty = "cast(array() as array<struct<i:int,lo:int,hi:int,words:bigint,cluster:bigint,removed:bigint>>)"
    one = lambda v: F.struct(v["i"].alias("i"), v["lo"].alias("lo"), v["hi"].alias("hi"), v["words"].cast("bigint").alias("words"), v["cluster"].alias("cluster"), F.when(v["removed"], v["words"]).otherwise(0).cast("bigint").alias("removed"))
    grown = lambda u, v: F.struct(v["i"].alias("i"), u["lo"].alias("lo"), v["hi"].alias("hi"), (u["words"] + v["words"]).alias("words"), u["cluster"].alias("cluster"), (u["removed"] + F.when(v["removed"], v["words"]).otherwise(0)).alias("removed"))
    joined = F.aggregate("hits", F.expr(empty), lambda s, v: F.when((F.size(s) > 0) & (F.element_at(s, -1)["i"] + 2 >= v["i"]), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(grown(F.element_at(s, -1), v)))).otherwise(F.concat(s, F.array(one(v)))))
    return runs.select("doc_id", "mark", F.explode(joined).alias("r")).where(F.col("r.words") >= least_run).select("doc_id", "mark", "r.lo", "r.hi", "r.words", "r.cluster", "r.removed")


def classes(grams: np.ndarray, bounds: np.ndarray, seeds=()) -> tuple[np.ndarray, np.ndarray | None]:
    """Class of each shingle set (the same for equal sets) and its MinHash values, a row for each seed."""
    n = len(bounds) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros((len(seeds), 0), U)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    at = np.searchsorted(o, np.arange(n))
    total = np.add.reduceat(mix(g), at) * U(2) + np.diff(np.append(at, len(g))).astype(U)
    low = np.stack([mix(np.minimum.reduceat(mix(g ^ s), at) ^ s) for s in seeds]) if len(seeds) else None
    return total.view(np.int64), low


def op4_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    """All repeated passages of documents of 16 words or more."""
    d = repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.drop("mark")
