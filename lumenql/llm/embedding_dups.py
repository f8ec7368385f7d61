"""Operator 8: near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, land, partitions, release, scratch, small, small_batches

#: Vectors of a tile, and rows of a tile that are compared at a time.
TILE, ROWS = 4096, 256
#: Tiles that a task of the comparison holds of one side, and pairs of tiles that go to Python at a time.
HELD_TILES, PAIRS = 64, 4
#: Classes that a task remembers to send their vectors once.
SEEN = 200_000
#: Dimensions that are accumulated before bounds are looked at.
LEADING = 16
#: Rounding that bounds allow for, in double and in single precision.
SLACK, SLACK32 = 1e-9, 1e-5


def packed(a: np.ndarray) -> list[bytes]:
    """The bytes of each row: in single precision if that keeps every value of the row, else in double."""
    with np.errstate(over="ignore", under="ignore"):
        short = a.astype(np.float32)
    same = (short == a).all(1)
    return [short[i].tobytes() if same[i] else a[i].tobytes() for i in range(len(a))]


def unpacked(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of doubles from bytes of packed()."""
    out = np.empty((len(data), dim))
    short = np.array([len(x) == 4 * dim for x in data], bool)
    for mine, kind in ((short, np.float32), (~short, np.float64)):
        at = np.flatnonzero(mine)
        if len(at):
            out[at] = np.frombuffer(b"".join([data[i] for i in at]), kind).reshape(-1, dim)
    return out


def read(column) -> tuple[np.ndarray, np.ndarray, list]:
    """(class, dimension, [(rows, matrix) for each dimension]) of a list array; dimension 0 marks vectors that link with nothing.

    The class is a hash of the values.
    """
    values = column.values
    offsets = column.offsets.to_numpy()
    dim = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    dim[bad[offsets[1:]] != bad[offsets[:-1]]] = 0
    values = values.fill_null(0.0).to_numpy()
    cls, found = np.zeros(len(dim), np.int64), []
    for d in np.unique(dim[dim > 0]):
        at = np.flatnonzero(dim == d)
        a = values[offsets[at][:, None] + np.arange(d)] + 0.0
        ok = np.isfinite(a).all(1) & a.any(1)
        dim[at[~ok]] = 0
        at, a = at[ok], a[ok]
        cls[at] = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in a]
        if len(at):
            found.append((at, a))
    return cls, dim, found


def classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(id, cls) of all vectors, cls being null for those that link with nothing, and (cls, dim, many, data) of distinct ones.

    The vectors themselves are shuffled once for each task that has them, in the precision that they need, and landed once.
    """
    given = vectors.select(F.col(key).cast("bigint"), F.col(column).cast("array<double>"))

    def named(batches):
        def rows():
            for x in batches:
                cls, dim, _ = read(x.column(1))
                yield {"id": x.column(0), "cls": pa.array(cls, mask=dim == 0)}

        return arrow_batches(rows(), {"id": pa.int64(), "cls": pa.int64()})

    def distinct(batches):
        def rows():
            seen: set[int] = set()
            for x in batches:
                cls, dim, found = read(x.column(1))
                for at, a in found:
                    c, first, many = np.unique(cls[at], return_index=True, return_counts=True)
                    new = np.array([v not in seen for v in c.tolist()], bool)
                    data: list = [None] * len(c)
                    for i, v in zip(np.flatnonzero(new), packed(a[first[new]]), strict=True):
                        data[i] = v
                    seen.update(c.tolist())
                    yield {"cls": c, "dim": dim[at[first]], "many": many, "data": data}
                if len(seen) > SEEN:
                    seen.clear()

        return arrow_batches(rows(), {"cls": pa.int64(), "dim": pa.int32(), "many": pa.int64(), "data": pa.binary()})

    ids = land(given.mapInArrow(named, "id bigint, cls bigint"), "vectors")
    ones = given.mapInArrow(distinct, "cls bigint, dim int, many bigint, data binary").groupBy("cls", "dim").agg(F.sum("many").alias("many"), F.first("data", ignorenulls=True).alias("data"))
    return ids, land(ones, "distinct")


def bases(ones: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension count the principal axes of all unit vectors, largest variance first; summed on the executors."""
    columns = {"dim": pa.int32(), "i": pa.int32(), "row": pa.list_(pa.float64())}

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            dims = x.column(0).to_numpy()
            for d in np.unique(dims):
                a = units(unpacked(x.column(1).filter(pa.array(dims == d)).to_pylist(), int(d)))
                sums[int(d)] = sums.get(int(d), 0) + a.T @ a
        return arrow_batches(({"dim": [d] * d, "i": range(d), "row": list(v)} for d, v in sums.items()), columns)

    cells = ones.select("dim", "data").mapInArrow(run, "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "x"))
    found = cells.groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    for d in np.unique(found.column("dim").to_numpy()):
        t = found.filter(pc.equal(found.column("dim"), pa.scalar(int(d), pa.int32())))
        gram = np.zeros((d, d))
        gram[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("x").to_numpy()
        _, axes = np.linalg.eigh((gram + gram.T) / 2)
        out[int(d)] = np.ascontiguousarray(axes[:, ::-1])
    return out


def units(a: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is brought to 1 first, so that no square over- or underflows."""
    a = a / np.abs(a).max(1)[:, None]
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, same: bool):
    """Yields (rows of a, links of these rows with b[at:] as booleans, at, or index pairs) for all links; with same only once a pair.

    The leading principal dimensions are multiplied first. What the rest can add is at most the product of the rest's
    norms, which stands as one more dimension, so one product in single precision tells which pairs cannot reach `least`,
    with SLACK32 for its rounding; the others go on by LEADING dimensions at a time in double precision, and the cosine of
    those that come through is computed from the vectors themselves. Where many pairs come through (copies of each other)
    whole rows are multiplied instead. Tiles are in the order of the second principal coordinate, so rows of b that are
    too far in it are left out.
    """
    ua, ub = units(a), units(b)
    pa_, pb = ua @ axes, ub @ axes
    d = a.shape[1]
    steps = list(range(LEADING, d, LEADING))  # none if the first LEADING dimensions are all
    tail = lambda p, k: np.sqrt(np.maximum((p[:, k:] ** 2).sum(1), 0))
    ta, tb = {k: tail(pa_, k) for k in steps}, {k: tail(pb, k) for k in steps}
    first = steps[0] if steps else d
    bound = lambda p, t: np.column_stack([p[:, :first], *([t[first]] if steps else [])]).astype(np.float32)
    ba, bb = bound(pa_, ta), bound(pb, tb)
    second = np.maximum.accumulate(pb[:, min(1, d - 1)])
    reach = reach_at(least) + SLACK32
    for at in range(0, len(a), ROWS):
        rows = np.arange(at, min(at + ROWS, len(a)))
        mine = pa_[rows, min(1, d - 1)]
        lo, hi = (0, len(b)) if d < 2 else (int(np.searchsorted(second, mine.min() - reach)), int(np.searchsorted(second, mine.max() + reach, "right")))
        alive = ba[rows] @ bb[lo:hi].T >= np.float32(least - SLACK32)
        if same:
            alive &= rows[:, None] < np.arange(lo, hi)
        if np.count_nonzero(alive) > 0.02 * alive.size:
            cos = ua[rows] @ ub[lo:hi].T
            links = (cos >= least) & alive
            close = np.argwhere(alive & (np.abs(cos - least) < SLACK))
            for i, j in close:
                links[i, j] = exact(a[rows[i]], b[lo + j]) >= least
            yield rows, links, lo, None
            continue
        i, j = np.divmod(np.flatnonzero(alive), max(1, hi - lo))
        i, j = rows[i], lo + j
        value = np.einsum("ij,ij->i", pa_[i, :first], pb[j, :first])
        for k, end in zip(steps, [*steps[1:], d], strict=False):
            value = value + np.einsum("ij,ij->i", pa_[i, k:end], pb[j, k:end])
            rest = ta[end][i] * tb[end][j] if end < d else 0.0
            ok = value + rest >= least - SLACK
            i, j, value = i[ok], j[ok], value[ok]
        if len(i):
            cos = np.einsum("ij,ij->i", ua[i], ub[j])
            for q in np.flatnonzero(np.abs(cos - least) < SLACK):
                cos[q] = exact(a[i[q]], b[j[q]])
            i, j = i[cos >= least], j[cos >= least]
            if len(i):
                yield rows, None, 0, (i, j)


def reach_at(least: float) -> float:
    """How far unit vectors with cosine >= least can be apart."""
    return math.sqrt(max(0.0, 2 - 2 * least)) + SLACK


def exact(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


def linked(ids_a, many_a, a, ids_b, many_b, b, axes, least: float, same: bool):
    """(nodes, links a node counted with copies) and edges that span the links of two tiles."""
    na = len(a)
    count = np.zeros(na + (0 if same else len(b)), np.int64)
    shift = 0 if same else na
    label = np.arange(len(count))
    edges = []

    def lower(u, new):
        old = label[u]
        ok = new < old
        if ok.any():
            edges.append(np.unique(np.stack([old[ok], new[ok]], 1), axis=0))
            label[u[ok]] = new[ok]
        return bool(ok.any())

    for rows, dense, lo, pairs in compare(a, b, axes, least, same):
        if dense is not None:
            if not dense.any():
                continue
            hi = lo + dense.shape[1]
            count[rows] += dense @ many_b[lo:hi]
            count[shift + lo : shift + hi] += many_a[rows] @ dense
            cols = np.flatnonzero(dense.any(0))
            sub = dense[:, cols]
            cols += lo
            top = len(count)
            on = True
            while on:
                on = lower(rows, np.where(sub, label[shift + cols][None, :], top).min(1))
                on |= lower(shift + cols, np.where(sub, label[rows][:, None], top).min(0))
        else:
            i, j = pairs
            np.add.at(count, i, many_b[j])
            np.add.at(count, shift + j, many_a[i])
            edges.append(np.stack([i, shift + j], 1))
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    pairs = np.unique(np.concatenate([*edges, np.stack([np.arange(len(count)), label], 1)]), axis=0) if edges else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    some = np.flatnonzero(count)
    return ids[some], count[some], ids[pairs[:, 0]], ids[pairs[:, 1]]


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of all rows: links are pairs of rows with cosine >= least, in double precision.

    Rows whose vector is null, empty, zero or has null or non-finite components link with nothing, nor do vectors of
    different length with each other. Rows with one key are rows of their own, an empty table gives none, and only the
    two columns named are read. Equal vectors are compared once and counted by their number. Vectors are ordered
    by their first principal coordinate and cut into tiles; unit vectors with cosine >= least differ by at most
    sqrt(2 - 2 least) in any coordinate, so only tiles within that distance meet. Each tile is landed once, and tasks read
    the two ranges of tiles that they compare from there, so what is shuffled and landed grows with the vectors, not with
    the pairs of tiles. Exact; with random vectors the comparisons grow with the square of distinct vectors.
    """
    with scratch(vectors.sparkSession) as keep:
        return keep(_near_vectors(vectors, least, key, column), "near")


def _near_vectors(vectors: DataFrame, least: float, key: str, column: str) -> DataFrame:
    spark = vectors.sparkSession
    rows, ones = classes(vectors, key, column)
    found = bases(ones)

    def along(data: list[bytes], dim: int, axis: int) -> np.ndarray:
        return units(unpacked(data, dim)) @ found[dim][:, min(axis, dim - 1)]

    def placed(batches):
        def made():
            for x in batches:
                dims, data, at = x.column(0).to_numpy(), x.column(1).to_pylist(), np.zeros(x.num_rows)
                for d in np.unique(dims):
                    mine = np.flatnonzero(dims == d)
                    at[mine] = along([data[i] for i in mine], int(d), 0)
                yield {"dim": dims, "x": at}

        return arrow_batches(made(), {"dim": pa.int32(), "x": pa.float64()})

    places = land(ones.select("dim", "data").mapInArrow(placed, "dim int, x double"), "places")
    sizes = {r["dim"]: r["n"] for r in places.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cuts: dict[int, list[float]] = {}
    for dim, n in sizes.items():
        k = math.ceil(n / TILE)
        cuts[dim] = [float(v) for v in places.where(F.col("dim") == dim).agg(F.percentile_approx("x", [i / k for i in range(1, k)], 100 * k)).first()[0]] if k > 1 else []
    # tiles of all dimensions are numbered one after the other; tile i of one lies between its cuts i - 1 and i, and its
    # partners j >= i begin at most `reach` behind its end
    base, high, reach = {}, [], reach_at(least) + SLACK32
    for dim, c in sorted(cuts.items()):
        base[dim] = len(high)
        high += [base[dim] + int(np.searchsorted(c, (c[i] if i < len(c) else np.inf) + reach, "right")) for i in range(len(c) + 1)]

    def tiled(batches):
        out = {"dim": pa.int32(), "tile": pa.int32(), "cls": pa.int64(), "many": pa.int64(), "data": pa.binary()}

        def made():
            for x in batches:
                cls, dims, data, tile = x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(3).to_pylist(), np.zeros(x.num_rows, np.int64)
                for d in np.unique(dims):
                    mine = np.flatnonzero(dims == d)
                    at = along([data[i] for i in mine], int(d), 0)
                    lo, hi = (np.searchsorted(cuts[int(d)], at, side) for side in ("left", "right"))
                    tile[mine] = base[int(d)] + lo + cls[mine] % (hi - lo + 1)
                yield {"dim": x.column(1), "tile": tile, "cls": x.column(0), "many": x.column(2), "data": x.column(3)}

        return arrow_batches(made(), out)

    def gathered(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        dim, tile, data = t.column("dim")[0].as_py(), t.column("tile")[0].as_py(), t.column("data").to_pylist()
        order = np.argsort(along(data, dim, 1), kind="stable")
        short = all(len(x) == 4 * dim for x in data)
        data = b"".join([data[i] for i in order]) if short else unpacked([data[i] for i in order], dim).tobytes()
        blob = lambda c: np.ascontiguousarray(t.column(c).to_numpy()[order], np.int64).tobytes()
        return pa.table({
            "dim": t.column("dim").slice(0, 1), "tile": t.column("tile").slice(0, 1), "high": pa.array([high[tile]], pa.int32()),
            "ids": pa.array([blob("cls")], pa.binary()), "many": pa.array([blob("many")], pa.binary()), "data": pa.array([data], pa.binary()),
        })

    parts = max(1, min(len(high), max(math.ceil(math.sqrt(4 * partitions(spark))), math.ceil(len(high) / HELD_TILES))))
    dealt = ones.select("cls", "dim", "many", "data").mapInArrow(tiled, "dim int, tile int, cls bigint, many bigint, data binary").repartition(parts, "dim", "tile")
    tiles = land(dealt.groupBy("dim", "tile").applyInArrow(gathered, "dim int, tile int, high int, ids binary, many binary, data binary"), "tiles", {"parquet.block.size": 8 << 20})
    release(ones)

    def met(batches):
        def matrix(ids: bytes, data: bytes, dim: int) -> np.ndarray:
            return np.frombuffer(data, np.float32 if 2 * len(data) == len(ids) * dim else np.float64).reshape(-1, dim).astype(np.float64)

        def made():
            for x in batches:
                for dim, i, j, *h in zip(*[c.to_pylist() for c in x.columns], strict=True):
                    x_, y_ = ([np.frombuffer(v[0], np.int64), np.frombuffer(v[1], np.int64), matrix(v[0], v[2], dim)] for v in (h[:3], h[3:]))
                    nodes, count, a, b = linked(*x_, *y_, found[dim], least, i == j)
                    yield {"a": nodes, "b": [None] * len(nodes), "n": count}
                    yield {"a": a, "b": b, "n": [None] * len(a)}

        return arrow_batches(made(), {"a": pa.int64(), "b": pa.int64(), "n": pa.int64()})

    # every pair of ranges of tiles is a task that reads both from the shared folder: nothing is shuffled
    tiles = tiles.coalesce(parts)
    p, q = tiles.alias("p"), tiles.alias("q").hint("shuffle_replicate_nl")
    pairs = p.join(q, (F.col("p.tile") <= F.col("q.tile")) & (F.col("q.tile") <= F.col("p.high")))
    pairs = pairs.select("p.dim", F.col("p.tile").alias("i"), F.col("q.tile").alias("j"), "p.ids", "p.many", "p.data", F.col("q.ids").alias("ids2"), F.col("q.many").alias("many2"), F.col("q.data").alias("data2"))
    with small_batches(spark, PAIRS):
        met_ = land(pairs.mapInArrow(met, "a bigint, b bigint, n bigint"), "links")
    release(tiles)
    count = met_.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = components(met_.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "root")
    of = land(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("many"), F.min("id").alias("least")).join(count, "cls", "left").join(roots, "cls", "left").select("cls", "many", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "cls").alias("root")), "of")
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(small(tops), "root").select("cls", (F.col("n") + F.col("many") - 1).alias("n_links"), "component_id")
    d = rows.join(small(of), "cls", "left")
    return d.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op8_embedding_dups(spark, sf_dir: str) -> DataFrame:
    """All vectors, links at cosine 0.95 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.95)
