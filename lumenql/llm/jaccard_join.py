"""Operator 9: exact n-gram Jaccard join by signature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, Forest, arrow_batches, by_part, components, land, partitions, parts_for, release, scratch, small, small_batches, tidy
from .textvec import LOWER, U, mix, parts, shingle_sets

#: Sets, and shingles, that a block's chunk holds on average; larger blocks are split.
CHUNK_SETS, CHUNK_SHINGLES = 512, 2_000_000
#: Bitmaps that a task on a group's open pairs holds of one chunk; larger groups are split.
GROUP_SETS = 4096
#: Children of a tree node, and least number of words of a bitmap.
FANOUT, BITMAP = 8, 32
#: Bits, probes and most entries of the filter of frequent tokens; a token counts as frequent from 2 ** LEAST_LEVEL sets.
FILTER_BITS, PROBES, FILTER_ENTRIES, LEAST_LEVEL = 1 << 25, 4, 2_000_000, 2
#: Sizes beyond this count as equal where sizes rule out links.
MOST_SIZE = (1 << 31) - 1
#: Tokens that a task counts, or packs keys of, before it sends them on.
HELD = 1_500_000
#: Bytes of texts that a task hashes at a time; a longer text is taken by itself.
TEXT_BYTES = 500_000


class Order:
    """A total order of tokens, rare ones first: by level, which is about log2 of how many sets have a token, then by hash.

    Levels are kept in a filter of fixed size: an entry for each frequent token and each level up to its own. The filter
    may take a token for more frequent than it is. That is the same for the token wherever it stands, so the order stays
    one order, and which pairs of sets meet depends on it only in number.
    """

    def __init__(self, bits: np.ndarray | None = None, least: int = LEAST_LEVEL, most: int = 0):
        self.bits, self.least, self.most = bits, least, most

    @staticmethod
    def places(tokens: np.ndarray, level: int):
        """The bits of tokens at a level, an array for each probe."""
        h = mix((tokens >> U(16)) ^ mix(np.full(1, level, U)))
        for k in range(PROBES):
            yield ((h + U(k) * (h >> U(32) | U(1))) % U(FILTER_BITS)).astype(np.int64)

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(tokens), np.int64), np.arange(len(tokens))
        if self.bits is None:
            return out
        for level in range(self.least, self.most + 1):
            mine = tokens[at]
            ok = np.ones(len(at), bool)
            for place in self.places(mine, level):
                ok &= (self.bits[place >> 6] >> (place & 63).astype(U) & U(1)).astype(bool)
            at = at[ok]
            if not len(at):
                break
            out[at] = level
        return out

    def prefix(self, tokens: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
        """The first tokens of a set such that two sets at or above the threshold have one of them in common.

        Similar sets share num/den of the larger one at least, so the least of the shared tokens stands among the first
        n - ceil(n * num / den) + 1 of each.
        """
        h = mix(tokens)
        most = len(tokens) - -(-len(tokens) * num // den) + 1
        return h[np.lexsort((h, levels))[:most]]


def counted(batches, width: int, count: int):
    """(part, n, first, gaps, at, times): distinct tokens, cut to 48 bits, of the distinct sets of some texts, dealt to count parts by range.

    n is their number, gaps are the differences of neighbours in 4 or 8 bytes; at and times say which tokens occur several times, and how often.
    """
    columns = {"part": pa.int64(), "n": pa.int64(), "first": pa.int64(), "gaps": pa.binary(), "at": pa.binary(), "times": pa.binary()}
    held, size = {}, 0

    def flush():
        v, n = np.unique(np.concatenate(list(held.values())) >> U(16), return_counts=True)
        step = (1 << 48) // count + 1
        cut = np.append(np.searchsorted(v, np.arange(count, dtype=np.int64).astype(U) * U(step)), len(v))
        rows = []
        for p in range(count):
            mine, times = v[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]
            if len(mine):
                gaps = np.diff(mine)
                many = np.flatnonzero(times > 1)
                kind = np.uint32 if not len(gaps) or gaps.max() < 1 << 32 else U
                rows.append((p, len(mine), int(mine[0]), gaps.astype(kind).tobytes(), many.astype(np.uint32).tobytes(), times[many].astype(np.uint32).tobytes()))
        return {k: [r[i] for r in rows] for i, k in enumerate(columns)}

    def rows():
        nonlocal size
        for x in batches:
            for _, _, data, offsets in parts(x.column(0), TEXT_BYTES):
                for s in shingle_sets(LOWER[data], offsets, width):
                    if len(s) and (c := set_class(s)) not in held:
                        held[c] = s
                        size += len(s)
            if size > HELD:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return arrow_batches(rows(), columns)


def totals(batches, least: int):
    """(token, n) of the tokens of counted(), dealt and sorted by part, that occur at least so often."""

    def rows():
        for held in by_part(batches):
            tokens, times = [], []
            for _, n, first, gaps, at, many in held:
                gaps = np.frombuffer(gaps, U if len(gaps) == 8 * (n - 1) else np.uint32)
                tokens.append(U(first) + np.concatenate([np.zeros(1, U), np.cumsum(gaps, dtype=U)]))
                times.append(np.ones(n, np.int64))
                times[-1][np.frombuffer(at, np.uint32)] = np.frombuffer(many, np.uint32)
            tokens, times = np.concatenate(tokens), np.concatenate(times)
            order = np.argsort(tokens)
            tokens, times = tokens[order], times[order]
            at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            n = np.add.reduceat(times, at)
            yield {"token": tokens[at][n >= least].astype(np.int64), "n": n[n >= least]}

    return arrow_batches(rows(), {"token": pa.int64(), "n": pa.int64()})


def token_order(docs: DataFrame, width: int, count: int) -> Order:
    """The order of the tokens of docs (text), from their numbers in all distinct sets (copies in one task's texts count once).

    Only the filter, of fixed size, comes to the driver. If more tokens are frequent than it can tell apart, it starts at
    a higher level.
    """
    packed = docs.select("text").mapInArrow(lambda x: counted(x, width, count), "part bigint, n bigint, first bigint, gaps binary, at binary, times binary")
    dealt = packed.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part")
    found = land(dealt.mapInArrow(lambda x: totals(x, 1 << LEAST_LEVEL), "token bigint, n bigint"), "frequent")
    level = F.length(F.bin("n")) - 1
    n = {r["level"]: r["n"] for r in found.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    if not n:
        return Order()
    least, most = LEAST_LEVEL, max(n)
    while sum((k - least + 1) * v for k, v in n.items() if k >= least) > FILTER_ENTRIES:
        least += 1

    def bits(batches):
        def rows():
            for x in batches:
                token, level = x.column(0).to_numpy().astype(U) << U(16), x.column(1).to_numpy()
                mine = np.zeros(FILTER_BITS // 64, U)
                for k in range(least, most + 1):
                    for place in Order.places(token[level >= k], k):
                        np.bitwise_or.at(mine, place >> 6, U(1) << (place & 63).astype(U))
                at = np.flatnonzero(mine)
                yield {"word": at, "bits": mine[at].view(np.int64)}

        return arrow_batches(rows(), {"word": pa.int64(), "bits": pa.int64()})

    words = found.select("token", level.cast("bigint").alias("level")).where(F.col("level") >= least).coalesce(partitions(docs.sparkSession)).mapInArrow(bits, "word bigint, bits bigint")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    return Order(out, least, most)


def set_class(tokens: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number; equal sets have equal ones."""
    x = (int(mix(tokens).sum(dtype=U)) * 2 + len(tokens)) % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


PACKED = {"part": pa.int32(), "keys": pa.binary(), "nodes": pa.binary(), "sizes": pa.binary()}
#: Nodes that may share a key in one batch before they are put under a hub of the batch.
LOCAL = 64


def runs(key: np.ndarray, node: np.ndarray, size: np.ndarray):
    """(key, node, size) sorted by key and size, and distinct, with the bounds of each key's run."""
    order = np.lexsort((node, size, key))
    key, node, size = key[order], node[order], size[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size = key[new], node[new], size[new]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key, node, size, np.append(np.flatnonzero(first), len(key))


def pack(key: np.ndarray, node: np.ndarray, count: int, size: np.ndarray | None = None):
    """Rows of PACKED: (key, node) pairs dealt to count parts by key, with the nodes' sizes if given.

    A key that more than LOCAL nodes of the batch have sends one node, the hub, marked by a part beyond count; part -1 has
    the (hub, node) memberships of such keys. So what is shuffled of a hot key is a few pairs a batch.
    """
    sized = size is not None
    key, node, size, at = runs(key, node, size if sized else np.zeros(len(key), np.int32))
    many = np.diff(at)
    hot = np.repeat(many > LOCAL, many)
    least = np.minimum.reduceat(node, at[:-1]) if len(node) else node
    rows = []
    for base, k, n, z in ((0, key[~hot], node[~hot], size[~hot]), (count, key[at[:-1]][many > LOCAL], least[many > LOCAL], size[:0])):
        cut = np.searchsorted(k, np.arange(1, count, dtype=object).astype(U) * U((1 << 64) // count + 1))
        cut = np.concatenate([[0], cut, [len(k)]])
        rows += [(base + p, k[cut[p] : cut[p + 1]].tobytes(), n[cut[p] : cut[p + 1]].tobytes(), z[cut[p] : cut[p + 1]].astype(np.int32).tobytes() if sized and not base else b"") for p in range(count) if cut[p] < cut[p + 1]]
    if hot.any():
        pairs = np.unique(np.stack([np.repeat(least, many)[hot], node[hot]], 1), axis=0)
        rows.append((-1, pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), b""))
    if rows:
        yield {k: [r[i] for r in rows] for i, k in enumerate(PACKED)}


def meet(packed: DataFrame, count: int, num: int = 0, den: int = 1) -> DataFrame:
    """Groups (grp, node) such that any two nodes with a key in common are in one group, if their sizes allow a link at num/den.

    grp is the least node of a key, or of a run of its nodes by size without a gap that no link spans.
    """

    def group(batches):
        for held in by_part(batches):
            if held[0][0] < 0:  # memberships under hubs
                a, b = (np.frombuffer(b"".join(h[i] for h in held), np.int64) for i in (2, 3))
                yield {"grp": a, "node": b, "merge": np.zeros(len(a), bool)}
                continue
            keys = np.concatenate([np.frombuffer(h[2], U) for h in held])
            nodes = np.concatenate([np.frombuffer(h[3], np.int64) for h in held])
            sizes = np.concatenate([np.frombuffer(h[4], np.int32) if h[4] else np.zeros(len(h[2]) // 8, np.int32) for h in held]).astype(np.int64)
            marks = np.repeat([h[1] >= count for h in held], [len(h[2]) // 8 for h in held])
            hubs = np.unique(np.stack([keys[marks].view(np.int64), nodes[marks]], 1), axis=0) if marks.any() else np.zeros((0, 2), np.int64)
            key, node, size, at = runs(keys, nodes, sizes)
            if not len(key):
                continue
            cut = np.ones(len(key), bool)
            cut[1:] = (key[1:] != key[:-1]) | (size[1:] * num > size[:-1] * den)
            if len(hubs):  # a hub stands for nodes of any size
                cut[1:] &= (key[1:] != key[:-1]) | ~np.isin(key[1:], hubs[:, 0].view(U))
            first = np.flatnonzero(cut)
            many = np.diff(np.append(first, len(key)))
            top = np.repeat(np.minimum.reduceat(node, first), many)
            some = np.repeat(many > 1, many)
            pairs = np.unique(np.stack([top[some], node[some]], 1), axis=0)
            # hubs of batches for one key bring their groups together
            of = np.searchsorted(key, hubs[:, 0].view(U)) if len(hubs) else np.zeros(0, np.int64)
            merges = np.unique(np.stack([top[of], hubs[:, 1]], 1), axis=0) if len(hubs) else hubs
            yield {"grp": np.concatenate([pairs[:, 0], merges[:, 0]]), "node": np.concatenate([pairs[:, 1], merges[:, 1]]), "merge": np.arange(len(pairs) + len(merges)) >= len(pairs)}

    fields = {"grp": pa.int64(), "node": pa.int64(), "merge": pa.bool_()}
    at = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("keys"), F.lit(count).cast("bigint"))).otherwise(F.col("part") % count)
    dealt = packed.select(at.cast("bigint").alias("at"), *PACKED).repartition(partitions(packed.sparkSession), "at").sortWithinPartitions("at")
    found = land(dealt.mapInArrow(lambda x: arrow_batches(group(x), fields), "grp bigint, node bigint, merge boolean").distinct(), "groups")
    groups = found.where("not merge").select("grp", "node")
    if found.where("merge and grp <> node").limit(1).count():
        roots = components(found.where("merge").select(F.col("grp").alias("a"), F.col("node").alias("b")))
        groups = groups.union(groups.select("grp", F.col("grp").alias("node")).distinct()).alias("g").join(small(roots).alias("r"), F.col("g.grp") == F.col("r.node"), "left").select(F.coalesce("r.root", "g.grp").alias("grp"), "g.node").distinct()
        groups = land(groups, "groups")
    return groups


def bitmap(tokens: np.ndarray, width: int = 0) -> np.ndarray:
    """Bitmap of a set as 64-bit words, BITMAP or, for large sets, as many as give two bits a token; or of a given width."""
    if not width:
        width = BITMAP
        while width * 32 < len(tokens):
            width *= 2
    out = np.zeros(width * 64, np.uint8)
    out[(tokens % U(width * 64)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(U)


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of words brought to a smaller width, as the same tokens set them there."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def stacked(maps: list) -> np.ndarray:
    """Bitmaps of several widths as rows of the least of these."""
    maps = [np.frombuffer(m, U) if isinstance(m, bytes) else m for m in maps]
    width = min(map(len, maps))
    return np.stack([folded(m[None, :], width)[0] for m in maps])


class Tree:
    """Signature tree over the sets of a chunk: a node has the OR of its sets' bitmaps, their size range and surplus.

    Surplus is the number of tokens beyond the bits they set. Two sets share at most popcount(AND of bitmaps) tokens
    with a bit of their own and the smaller surplus; for nodes, with ORs and largest surpluses, this bounds all pairs.
    """

    def __init__(self, maps: np.ndarray, size: np.ndarray, root: np.ndarray):
        """root: what each set is known to be joined to; pairs of nodes with one and the same are left out."""
        surplus = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        order = np.lexsort((maps[:, 0], size))
        self.items, self.levels = order, [(maps[order], size[order], size[order], surplus[order], root[order], root[order])]
        self.grow()

    def narrow(self, width: int) -> None:
        """Folds all bitmaps; the surplus grows by the bits that fall together."""
        leaf = self.levels[0]
        small_ = folded(leaf[0], width)
        surplus = leaf[3] + np.bitwise_count(leaf[0]).sum(1).astype(np.int64) - np.bitwise_count(small_).sum(1).astype(np.int64)
        self.levels = [(small_, leaf[1], leaf[2], surplus, leaf[4], leaf[5])]
        self.grow()

    def grow(self) -> None:
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, s, a, b = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(s, at), np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)))

    def pairs(self, other: Tree, num: int, den: int):
        """Index pairs of sets that the bound can't part, by traversing both trees from their roots."""
        width = min(self.levels[0][0].shape[1], other.levels[0][0].shape[1])
        for t in (self, other):
            if t.levels[0][0].shape[1] > width:
                t.narrow(width)
        top = max(len(self.levels), len(other.levels)) - 1
        i = j = np.zeros(1, np.int64)  # from here on pairs of nodes of one level
        for depth in range(top, -1, -1):
            if not len(i):
                break
            (m, lo, hi, s, ra, rb), (n, lo2, hi2, s2, ra2, rb2) = (t.levels[min(depth, len(t.levels) - 1)] for t in (self, other))
            keep = []
            for k in range(0, len(i), 65536):
                a, b = i[k : k + 65536], j[k : k + 65536]
                most = np.bitwise_count(m[a] & n[b]).sum(1, dtype=np.int64) + np.minimum(s[a], s2[b])
                most = np.minimum(most, np.minimum(hi[a], hi2[b]))
                one = (ra[a] == rb[a]) & (ra2[b] == rb2[b]) & (ra[a] == ra2[b])
                keep.append(~one & (most * (num + den) >= num * (lo[a] + lo2[b])) & (hi[a] * den >= num * lo2[b]) & (hi2[b] * den >= num * lo[a]))
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
            if depth:
                fan = lambda t, x: (x[:, None] * FANOUT + np.arange(FANOUT), len(t.levels[depth - 1][1])) if depth < len(t.levels) else (x[:, None], len(t.levels[-1][1]))  # noqa: B023, E731
                (a, na), (b, nb) = fan(self, i), fan(other, j)
                a, b = np.broadcast_arrays(a[:, :, None], b[:, None, :])
                a, b = a.ravel(), b.ravel()
                ok = (a < na) & (b < nb)
                i, j = a[ok], b[ok]
        return self.items[i], other.items[j]


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    n = len(x) + len(y)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    inter = int((y[at] == x).sum())
    return den * inter >= num * (n - inter)


def tree_edges(node: list[int], side: list[int], data: list[bytes], num: int, den: int, forest: Forest) -> list[tuple[int, int]]:
    """Links that join what the forest has not joined yet: inside side 1 (side 0 alone if there is no side 1) and between sides."""
    sets = [np.frombuffer(x, U) for x in data]
    groups = [[k for k, s in enumerate(side) if s == v] for v in (0, 1)]
    trees = [Tree(stacked([bitmap(sets[k]) for k in g]), np.array([len(sets[k]) for k in g]), np.array([forest.root(node[k]) for k in g])) if g else None for g in groups]
    edges = []
    for p, q in ([(0, 0)] if not groups[1] else [(1, 1), (0, 1)] if groups[0] else [(1, 1)]):
        for a, b in zip(*trees[p].pairs(trees[q], num, den), strict=True):
            a, b = groups[p][a], groups[q][b]
            if node[a] == node[b] or p == q and a >= b or forest.root(node[a]) == forest.root(node[b]):
                continue
            if similar(sets[a], sets[b], num, den):
                forest.join(node[a], node[b])
                edges.append((node[a], node[b]))
    return edges


def jaccard_classes(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n, cls, root) of docs (doc_id, text): all links with Jaccard >= num/den between distinct word-shingle sets.

    n is the set's size, cls its class (copies share it), root the least class that links reach. Words are lower-cased
    for A to Z. A text with fewer words than width has one shingle; null, empty and white-space texts have none and
    link with nothing (root null). Rows with one doc_id are separate rows of the result. An empty table gives no rows;
    long texts count whole. Exact but for 64-bit collisions of hashes.

    Sets that could be similar meet by a token of their prefixes in an order that puts frequent tokens last (see Order):
    a passage that many texts share brings only those together that have little else. First each set goes with the least
    hub of its groups that bitmaps allow a link to, and the sets of a hub are joined by signature trees. That makes
    components of copies of one text in work proportional to their number, even if these are a third of all rows. Then, in
    groups that still hold several components, trees of bitmaps alone find the sets in pairs across components that the
    bound allows, and only these are joined with their sets.
    """
    with scratch(docs.sparkSession) as keep, small_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return keep(_classes(docs, width, num, den), "classes")


def _classes(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    count = parts_for(docs)
    order = spark.sparkContext.broadcast(token_order(docs, width, count))
    tidy(spark)

    def signed(batches):
        """The table of sets with their bitmaps, and packed keys under doc_id null, part set."""
        columns = {"doc_id": pa.int64(), "mark": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "map": pa.binary(), **PACKED}
        keys, nodes, sizes, held = [], [], [], 0

        def flush():
            for x in pack(np.concatenate(keys), np.concatenate(nodes), count, np.concatenate(sizes)):
                none = [None] * len(x["part"])
                yield {"doc_id": none, "mark": none, "n": none, "cls": none, "map": none, **x}
            for x in (keys, nodes, sizes):
                x.clear()

        def rows():
            nonlocal held
            for x in batches:
                ids, marks = x.column(0), x.column(2)
                for at, n, data, offsets in parts(x.column(1), TEXT_BYTES):
                    found = list(shingle_sets(LOWER[data], offsets, width))
                    cls = [set_class(s) for s in found]
                    yield {"doc_id": ids.slice(at, n).to_pylist(), "mark": marks.slice(at, n).to_pylist(), "n": [len(s) for s in found], "cls": cls, "map": [bitmap(s).tobytes() for s in found], **{k: [None] * n for k in PACKED}}
                    one = {c: s for c, s in zip(cls, found, strict=True) if len(s)}
                    if not one:
                        continue
                    bounds = np.cumsum([len(s) for s in one.values()])[:-1]
                    levels = np.split(order.value.levels(np.concatenate(list(one.values()))), bounds)
                    for (c, s), level in zip(one.items(), levels, strict=True):
                        keys.append(order.value.prefix(s, level, num, den))
                        nodes.append(np.full(len(keys[-1]), c, np.int64))
                        sizes.append(np.full(len(keys[-1]), min(len(s), MOST_SIZE), np.int32))
                        held += len(keys[-1])
                if held > HELD:
                    yield from flush()
                    held = 0
            if keys:
                yield from flush()

        return arrow_batches(rows(), columns)

    base = land(keyed(docs).mapInArrow(signed, "doc_id bigint, mark bigint, n bigint, cls bigint, map binary, part int, keys binary, nodes binary, sizes binary"), "sets")
    groups = meet(base.where("part is not null").select(*PACKED), count, num, den)
    every = base.where("part is null")
    rows = land(every.select("doc_id", "n", "cls"), "rows")
    nodes = small(land(groups.select(F.col("node").alias("cls")).distinct(), "nodes"))
    ones = land(every.where("n > 0").join(nodes, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.when(F.min("doc_id").isNull(), F.min("mark")).alias("mark"), F.max("n").alias("n"), F.first("map").alias("map")), "ones")
    release(base)
    # first each set with the least group whose hub it can be linked to
    hub = ones.select(F.col("cls").alias("grp"), F.col("map").alias("hub_map"), F.col("n").alias("hub_n"))
    near = groups.join(ones.select(F.col("cls").alias("node"), "map", "n"), "node").join(hub, "grp").where("node <> grp")
    near = near.select("grp", "node", "n", "map", "hub_n", "hub_map").mapInArrow(lambda x: could_link(x, num, den), "grp bigint, node bigint").groupBy("node").agg(F.min("grp").alias("block"))
    near = land(near, "near")
    near = near.select(F.col("node").alias("cls"), "block").union(near.select("block", "block").distinct())
    links = link_blocks(members_of(docs, near, ones, width), num, den, every=False)
    # then what the groups hold beyond the components found
    roots = components(links)
    known = groups.join(small(roots).select("node", "root"), "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    open_ = known.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    open_ = open_.select("grp", F.ceil(F.col("m") / GROUP_SETS).alias("chunks"))
    left = known.join(open_, "grp").join(ones.select(F.col("cls").alias("node"), "map", "n"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    tasks = left.select("grp", "node", "root", "n", "map", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other"))
    tasks = tasks.select("grp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", "root", "n", "map")
    more = tasks.repartition(partitions(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(lambda x: open_pairs(x, num, den), "grp bigint, node bigint").distinct()
    more = land(more.select(F.col("node").alias("cls"), F.col("grp").alias("block")), "more")
    if more.limit(1).count():
        links = links.union(link_blocks(members_of(docs, more, ones, width), num, den))
        roots = components(links)
    return rows.join(small(roots), rows["cls"] == roots["node"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"), F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("root"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark is xxhash64(text) for rows with a null doc_id, which it tells apart, null for others."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return d.withColumn("mark", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))


def members_of(docs: DataFrame, blocks: DataFrame, ones: DataFrame, width: int) -> DataFrame:
    """blocks (cls, block) with their sets, as link_blocks() takes them; texts are read again for the classes asked for."""
    want = in_chunks(blocks.join(ones.select("cls", "doc_id", "mark", "n"), "cls"))
    wanted = want.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "cls").agg(F.collect_list(F.struct("block", "chunk", "chunks")).alias("places"))
    texts = keyed(docs).join(small(land(wanted, "wanted")), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("mark").eqNullSafe(F.col("__mark"))).select("cls", "text", "places")

    def sets(batches):
        def rows():
            for x in batches:
                want = x.column(0).to_pylist()
                for at, n, data, offsets in parts(x.column(1), TEXT_BYTES):
                    found = list(shingle_sets(LOWER[data], offsets, width))
                    ok = [k for k in range(n) if set_class(found[k]) == want[at + k]]
                    places = [x.column(2)[at + k].as_py() for k in ok]
                    yield {"cls": [want[at + k] for k in ok], "data": [found[k].tobytes() for k in ok], "places": places}

        for r in rows():
            kind = pa.list_(pa.struct([("block", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(r["cls"], pa.int64()), pa.array(r["data"], pa.binary()), pa.array(r["places"], kind)], names=["cls", "data", "places"])

    got = land(texts.mapInArrow(sets, "cls bigint, data binary, places array<struct<block:bigint,chunk:bigint,chunks:bigint>>"), "members")
    return got.select("cls", "data", F.explode("places").alias("p")).select("cls", "p.block", "p.chunk", "p.chunks", "data")


def could_link(batches, num: int, den: int):
    """(grp, node) of rows (grp, node, n, map, hub_n, hub_map) whose bitmaps and sizes do not rule a link out."""

    def rows():
        for x in batches:
            n, k = x.column(2).to_numpy(), x.column(4).to_numpy()
            m, h = x.column(3).to_pylist(), x.column(5).to_pylist()
            size = np.array([(len(u), len(v)) for u, v in zip(m, h, strict=True)], np.int64).reshape(-1, 2)
            ok = np.zeros(len(n), bool)
            for u, v in np.unique(size, axis=0):
                at = np.flatnonzero((size[:, 0] == u) & (size[:, 1] == v))
                width = min(u, v) // 8
                p, q = (folded(np.frombuffer(b"".join(y[i] for i in at), U).reshape(len(at), -1), width) for y in (m, h))
                surplus = np.minimum(n[at] - np.bitwise_count(p).sum(1).astype(np.int64), k[at] - np.bitwise_count(q).sum(1).astype(np.int64))
                most = np.minimum(np.bitwise_count(p & q).sum(1).astype(np.int64) + surplus, np.minimum(n[at], k[at]))
                ok[at] = most * (num + den) >= num * (n[at] + k[at])
            yield {"grp": x.column(0).to_numpy()[ok], "node": x.column(1).to_numpy()[ok]}

    return arrow_batches(rows(), {"grp": pa.int64(), "node": pa.int64()})


def open_pairs(batches, num: int, den: int):
    """(grp, node) of all sets of tasks (grp, i, j, side, node, root, n, map) in a pair that trees of bitmaps can't part."""

    def done(held):
        side = np.array([h[3] for h in held])
        trees, nodes = [], []
        for v in (0, 1):
            own = [h for h, s in zip(held, side, strict=True) if s == v]
            nodes.append(np.array([h[4] for h in own], np.int64))
            trees.append(Tree(stacked([h[7] for h in own]), np.array([h[6] for h in own]), np.array([h[5] for h in own])) if own else None)
        both = (0, 0) if held[0][1] == held[0][2] else (0, 1)
        if trees[both[0]] is None or trees[both[1]] is None:
            return {"grp": [], "node": []}
        a, b = trees[both[0]].pairs(trees[both[1]], num, den)
        found = np.unique(np.concatenate([nodes[both[0]][a], nodes[both[1]][b]]))
        return {"grp": [held[0][0]] * len(found), "node": found}

    def rows():
        held = []
        for x in batches:
            for h in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if held and h[:3] != held[-1][:3]:
                    yield done(held)
                    held = []
                held.append(h)
        if held:
            yield done(held)

    return arrow_batches(rows(), {"grp": pa.int64(), "node": pa.int64()})


def in_chunks(ones: DataFrame) -> DataFrame:
    """(cls, block, n) and others with chunk and chunks: blocks of more than a chunk's sets or shingles are split by hash."""
    chunks = ones.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    return ones.join(small(chunks), "block").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))


def link_blocks(members: DataFrame, num: int, den: int, every: bool = True) -> DataFrame:
    """Links (a, b) that span all links inside the blocks of landed members (cls, block, chunk, chunks, data).

    Without every, chunks of one block are compared with themselves and with chunk 0 only.
    """
    spark = members.sparkSession

    def joined(tasks: DataFrame) -> DataFrame:
        """Links of tasks (block, i, j, side, cls, root, data); root is what cls is known to be joined to."""

        def run(batches):
            held, now = [], None

            def done():
                forest = Forest()
                for _, _, _, _, c, r, _ in held:
                    if r is not None and r != c:
                        forest.join(c, r)
                found = tree_edges([h[4] for h in held], [h[3] for h in held], [h[6] for h in held], num, den, forest) if len(held) > 1 else []
                return {"a": [e[0] for e in found], "b": [e[1] for e in found]}

            def rows():
                nonlocal held, now
                for x in batches:
                    for h in zip(*[x.column(i).to_pylist() for i in range(7)], strict=True):
                        if h[:3] != now:
                            if held:
                                yield done()
                            held, now = [], h[:3]
                        held.append(h)
                if held:
                    yield done()

            return arrow_batches(rows(), {"a": pa.int64(), "b": pa.int64()})

        dealt = tasks.repartition(partitions(spark), "block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "cls")
        return dealt.mapInArrow(run, "a bigint, b bigint")

    star = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).otherwise(F.array(F.col("chunk").cast("int")))
    first = members.select("block", F.lit(0).alias("i"), F.explode(star).alias("j"), "chunk", "cls", F.lit(None).cast("bigint").alias("root"), "data")
    first = first.select("block", "i", "j", F.when(F.col("chunk") == F.col("j"), (F.col("j") > 0).cast("int")).otherwise(F.lit(0)).alias("side"), "cls", "root", "data")
    links = land(joined(first), "links")
    if every and members.where("chunks > 2").limit(1).count():
        links = _second_round(members, links, joined, num, den)
    return links


def _second_round(members: DataFrame, links: DataFrame, joined, num: int, den: int) -> DataFrame:
    """Adds the links between chunks of the large blocks that the first round did not compare and can't rule out."""
    roots = components(links)
    large = members.where("chunks > 2")
    known = large.join(small(roots), large["cls"] == roots["node"], "left").select("block", "chunk", "cls", F.coalesce("root", "cls").alias("root"), "data")

    def described(batches):
        columns = {"block": pa.int64(), "chunk": pa.int64(), "root": pa.int64(), "n": pa.int64(), "surplus": pa.int64(), **{f"w{k}": pa.int64() for k in range(BITMAP)}}

        def rows():
            for x in batches:
                maps, size = [], []
                for v in x.column(3):
                    s = np.frombuffer(v.as_py(), U)
                    maps.append(bitmap(s, BITMAP).view(np.int64))
                    size.append(len(s))
                maps, size = np.array(maps, np.int64).reshape(-1, BITMAP), np.array(size, np.int64)
                yield {"block": x.column(0), "chunk": x.column(1), "root": x.column(2), "n": size, "surplus": size - np.bitwise_count(maps.view(U)).sum(1).astype(np.int64), **{f"w{k}": maps[:, k] for k in range(BITMAP)}}

        return arrow_batches(rows(), columns)

    fields = "block bigint, chunk bigint, root bigint, n bigint, surplus bigint, " + ", ".join(f"w{k} bigint" for k in range(BITMAP))
    nodes = land(known.select("block", "chunk", "root", "data").mapInArrow(described, fields).groupBy("block", "chunk").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("surplus").alias("surplus"), *[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(BITMAP)]), "nodes")
    p, q = nodes.where("chunk > 0").alias("p"), nodes.alias("q")
    shared = sum((F.bit_count(F.col(f"p.w{k}").bitwiseAND(F.col(f"q.w{k}"))) for k in range(BITMAP)), F.lit(0))
    bound = F.least(shared + F.least("p.surplus", "q.surplus"), F.least("p.most", "q.most"))
    one = (F.col("p.lo") == F.col("p.hi")) & (F.col("q.lo") == F.col("q.hi")) & (F.col("p.lo") == F.col("q.lo"))
    pairs = p.join(q, (F.col("p.block") == F.col("q.block")) & (F.col("p.chunk") < F.col("q.chunk"))).where(~one & (bound * (num + den) >= num * (F.col("p.least") + F.col("q.least"))))
    pairs = land(pairs.select(F.col("p.block").alias("block"), F.col("p.chunk").cast("int").alias("i"), F.col("q.chunk").cast("int").alias("j")), "pairs")
    if not pairs.limit(1).count():
        return links
    ends = pairs.select("block", "i", "j", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("chunk")), F.struct(F.lit(1).alias("side"), F.col("j").alias("chunk")))).alias("e")).select("block", "i", "j", "e.side", "e.chunk")
    tasks = known.join(ends, ["block", "chunk"]).select("block", "i", "j", "side", "cls", "root", "data")
    return links.union(land(joined(tasks), "links"))


def named(classes: DataFrame) -> DataFrame:
    """jaccard_classes() with component_id, the least doc_id of the component; rows without shingles stand alone."""
    of = classes.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    d = classes.alias("c").join(of.alias("o"), F.col("c.root") == F.col("o.root"), "left")
    return d.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs, all columns kept, with one row of each group that links reach: that of the least doc_id.

    Rows without shingles all stay. Of rows with that doc_id in the group one stays (the least by all columns' hash).
    """
    d = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    with scratch(docs.sparkSession) as keep:
        drop, again = _surplus(d, jaccard_classes(d.select(F.col("__rid").alias("doc_id"), "text"), width, num, den), keep)
    kept = d.join(small(drop), F.col("__rid") == F.col("__drop"), "left_anti")
    once = kept.join(small(again), F.col("__rid") == F.col("__twice"), "left_anti")
    one = kept.join(small(again), F.col("__rid") == F.col("__twice"), "left_semi").dropDuplicates(["__rid"])
    return once.union(one).drop("__rid")


def _surplus(d: DataFrame, found: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Keys __drop of the rows of d that go, and __twice of those that stay but are there several times."""
    names = found.where("root is not null").select(F.col("doc_id").alias("__key"), "root").distinct()
    groups = d.select("__rid", F.col("doc_id").alias("__id")).join(names, F.col("__rid") == F.col("__key"))
    order = F.struct(F.col("__id").isNull(), "__id", "__rid")
    tops = groups.groupBy("root").agg(F.min(order)["__rid"].alias("__top"))
    drop = keep(groups.select("__rid", "root").distinct().join(small(land(tops, "tops")), "root").where("__rid <> __top").select(F.col("__rid").alias("__drop")).distinct(), "drop")
    again = d.groupBy("__rid").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("__rid").alias("__twice")).join(names, F.col("__twice") == F.col("__key"), "left_semi")
    return drop, keep(again.join(drop, F.col("__twice") == F.col("__drop"), "left_anti"), "again")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, sets of 3-word shingles, links at Jaccard 0.9 or more."""
    return named(jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 9, 10))
