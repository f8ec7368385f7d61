"""Operator 5: benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, land
from .textvec import LOWER, U, mix, parts, prefix, spans, window_hashes, words

#: Words of a template window, and how many of them must be no placeholders.
WIDTH, LITERAL = 8, 5
#: A document has an item if a run of so many words matches, or this share of the item's words.
RUN, SHARE = 13, 0.5
#: Benchmark windows (8 bytes each) up to which documents are filtered where they are read; beyond, windows are shuffled.
FILTER_WINDOWS = 2_000_000
# Names of units that follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years ms us ns hz khz mhz ghz b kb mb gb tb bit bits byte bytes "
    "w kw mw v kv a ma j kj cal kcal n pa kpa bar c f k degrees degree percent euro euros dollar dollars cent cents eur usd gbp"
).split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_END = np.zeros(256, bool)
_END[list(b".!?:")] = True
NUMBER, NAME, UNIT, RAW = (U(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x4444444444444444))
_UNITS = np.unique(np.concatenate([mix(spans(prefix(np.frombuffer(x.encode(), np.uint8)), np.zeros(1, np.int64), np.full(1, len(x))) + U(len(x))) for x in UNITS]))


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, A to Z and the letters of Latin-1."""
    out = LOWER[data]
    if len(data) > 1:
        second = data[1:]
        out[1:] += ((data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)).astype(np.uint8) * np.uint8(32)
    return out


def canonical(data: np.ndarray, offsets: np.ndarray):
    """Template words: start, end, template hash, hash of the word itself, first word of each text.

    A word is what stands between white space without the signs at its ends; words of signs alone are left out. Case is
    ignored for A to Z and Latin-1. Words that begin with a digit are numbers, a unit after a number is a unit, and a word with one capital, its
    first, is a name unless it begins a line or follows the end of a sentence.
    """
    start, end, first = words(data, offsets)
    at = np.flatnonzero(_WORD[data])
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    ok = b > a
    raw, start, end = end[ok], at[a[ok]], at[b[ok] - 1] + 1
    first = np.concatenate([[0], np.cumsum(ok)])[first]
    if not len(start):
        return start, end, np.zeros(0, U), np.zeros(0, U), first
    count = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    upper, lines = count(_UPPER[data]), count(data == 10)
    h = mix(spans(prefix(lowered(data)), start, end) + (end - start).astype(U))
    number = _DIGIT[data[start]]
    opens = np.ones(len(start), bool)
    opens[1:] = _END[data[raw[:-1] - 1]] | (lines[start[1:]] > lines[raw[:-1]])
    opens[first[:-1][first[:-1] < len(start)]] = True
    wide = np.zeros(len(start), bool)
    two = end - start > 1
    wide[two] = (data[start[two]] == 0xC3) & (data[start[two] + 1] >= 0x80) & (data[start[two] + 1] <= 0x9E)
    name = ~opens & (end - start > 1) & ((_UPPER[data[start]] & (upper[end] - upper[start] == 1)) | (wide & (upper[end] == upper[start])))
    after = np.zeros(len(start), bool)
    after[1:] = number[:-1]
    after[first[:-1][first[:-1] < len(start)]] = False
    unit = after & ~number & np.isin(h, _UNITS)
    return start, end, np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h))), h, first


def among(wanted: np.ndarray | None):
    """A function that tells which values of an array are in a sorted one (all if None)."""
    if wanted is None:
        return lambda x: np.ones(len(x), bool)
    bits = max(16, (8 * len(wanted)).bit_length())
    some = np.zeros(1 << bits, bool)
    some[wanted >> U(64 - bits)] = True

    def found(x):
        out = some[x >> U(64 - bits)]
        out[out] = np.isin(x[out], wanted)
        return out

    return found


def template_windows(ids, data: np.ndarray, offsets: np.ndarray, wanted, width: int = WIDTH, sizes: list[int] | None = None):
    """Rows (id, row, pos, window, size, n, slots, raw) of the windows of texts that are wanted, by among().

    Windows have the given sizes; without sizes they have width words, and a text with fewer words has one window, of all
    of them. slots are the texts of the placeholders of a window. Each window is given raw, for its words as they are,
    lower-cased, without slots; one with LITERAL words that are no placeholders also for its template. n is the number of words of
    the text, row its number.
    """
    start, end, h, word, first = canonical(data, offsets)
    slot = (h == NUMBER) | (h == NAME) | (h == UNIT)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    texts, pos, size, value, raw = [], [], [], [], []
    for k in sizes or range(1, width + 1):
        grams, plain = window_hashes(h, k), mix(window_hashes(word, k) ^ RAW)
        if not len(grams):
            continue
        inside = owner[: len(grams)] == owner[k - 1 :]
        if not sizes and k < width:
            inside &= count[owner[: len(grams)]] == k
        rich = literal[k:] - literal[:-k] >= LITERAL
        for x, ok, is_raw in ((grams, inside & rich, False), (plain, inside, True)):
            at = np.flatnonzero(ok)
            at = at[wanted(x[at])]
            texts.append(owner[at]), pos.append(at), size.append(np.full(len(at), k)), value.append(x[at]), raw.append(np.full(len(at), is_raw))
    texts, pos, size, value, raw = (np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in ((texts, np.int64), (pos, np.int64), (size, np.int64), (value, U), (raw, bool)))
    slots = [[] if r else [lowered(data[start[k] : end[k]]).tobytes().decode("utf-8", "replace") for k in range(p, p + s) if slot[k]] for p, s, r in zip(pos, size, raw, strict=True)]
    return {"id": ids.take(pa.array(texts)), "row": texts, "pos": pos - first[texts], "window": value.view(np.int64), "size": size, "n": count[texts], "slots": slots, "raw": raw}


COLUMNS = {"id": pa.int64(), "row": pa.int64(), "pos": pa.int64(), "window": pa.int64(), "size": pa.int64(), "n": pa.int64(), "slots": pa.list_(pa.string()), "raw": pa.bool_()}
SCHEMA = "id bigint, row bigint, pos bigint, window bigint, size bigint, n bigint, slots array<string>, raw boolean"


def windows_of(texts: DataFrame, width: int, wanted=None, sizes: list[int] | None = None) -> DataFrame:
    """texts: (id bigint, row bigint, text) -> windows; row is passed through. wanted: a broadcast sorted array, or None."""

    def run(batches):
        def rows():
            test = among(wanted.value if wanted is not None else None)
            for x in batches:
                for at, n, data, offsets in parts(x.column(2), 500_000):
                    found = template_windows(x.column(0).slice(at, n), data, offsets, test, width, sizes)
                    yield found | {"row": x.column(1).slice(at, n).take(pa.array(found["row"]))}

        return arrow_batches(rows(), COLUMNS)

    return texts.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, run: int = RUN, share: float = SHARE) -> DataFrame:
    """(doc_id, mark, item_id, words, item_words, exact) of documents (doc_id, text) with passages of benchmark (item_id, text).

    Template windows of `width` words, for shorter items of all their words, are hash-joined if they have LITERAL literal words,
    and all windows by their words as they are, case ignored. Matches of a document and an item at one distance make a run; one of words
    as they are always counts, one of templates if each of the item's slot values stands for one value in the document, whichever it is, so that questions
    with other numbers, names or units are found and chance matches are not. A pair is returned if a run has `run` words or all
    runs together `share` of the item's; words is how many of the item's are covered, exact tells whether all slots have the item's
    own values. mark is xxhash64(text), which tells rows with one doc_id apart. Items with less than LITERAL literal words
    match word for word only, be it one word; null or empty texts match nothing; repeated rows match each for themselves but give one row.
    Texts count whole, whatever their length; empty tables on either side give no rows; only the columns named are read.

    The benchmark's window hashes go to the executors if there are at most FILTER_WINDOWS, so only hits are shuffled.
    """
    items = land(windows_of(benchmark.select(F.col("item_id").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("row"), "text"), width), "items")
    few = items.select("window").distinct()
    wanted = None
    if few.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS:
        wanted = np.sort(few.toArrow().column("window").to_numpy().astype(np.int64).view(U))
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    hits = land(windows_of(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("row"), "text"), width, wanted, sizes or [width]), "hits")
    i = items.select(F.col("id").alias("item_id"), F.col("pos").alias("at"), "window", "size", F.col("n").alias("item_words"), F.col("slots").alias("own"), "raw")
    both = hits.select(F.col("id").alias("doc_id"), F.col("row").alias("mark"), "pos", "window", "size", "slots", "raw").join(i, ["window", "size", "raw"])
    both = both.where(F.size("own") == F.size("slots")).distinct()
    runs = both.groupBy("doc_id", "mark", "item_id", "item_words", "raw", (F.col("pos") - F.col("at")).alias("distance")).agg(
        F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1))).alias("words"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("own").alias("own"), F.col("slots").alias("slots"))))).alias("pairs"),
    )
    runs = runs.withColumn("words", F.array_distinct("words")).where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["own"]))) == F.size("pairs"))
    longest = F.aggregate(
        F.array_sort("words"), F.struct(F.lit(-2).cast("bigint").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, v: F.struct(v.alias("last"), F.when(v == s["last"] + 1, s["now"] + 1).otherwise(1).alias("now"), F.greatest(s["most"], F.when(v == s["last"] + 1, s["now"] + 1).otherwise(1)).alias("most")),
    )["most"]
    same = F.forall("pairs", lambda p: p["own"] == p["slots"])
    out = runs.withColumn("longest", longest).withColumn("exact", same).groupBy("doc_id", "mark", "item_id", "item_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("bigint").alias("words"), F.max("longest").alias("longest"), F.bool_and("exact").alias("exact")
    )
    return out.where((F.col("longest") >= run) | (F.col("words") >= F.col("item_words") * share)).select("doc_id", "mark", "item_id", "words", "item_words", "exact")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, all columns kept."""
    bad = land(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "bad")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents with passages of the benchmark, one row a document and item."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, bench).drop("mark")
