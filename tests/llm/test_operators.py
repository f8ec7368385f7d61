"""The ten operators and the pipeline against brute force, with edge cases in the tables of conftest.py."""

import hashlib
import html
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from xml.etree import ElementTree

import numpy as np
import pytest

import corpus_pipeline
from lumenql.llm import decontaminate, embedding_dups, html_extract, jaccard_join, licences, paragraph_dedup, quality, suffix_dedup, textvec
from lumenql.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="session")
def docs(spark, tiny):
    return [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source").collect()]


def rows(spark, name, path):
    return QUERIES[name](spark, path).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_mix(spark, tiny, docs):
    got = rows(spark, "op1_mix", tiny)
    assert len(got) == len(docs) and sum(r["size"] for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in docs)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"]
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in by}
    left, full = 1.5 * sum(size.values()), {}
    while True:  # water filling, step by step
        open_ = [s for s in by if s not in full]
        level = (left - sum(full.values())) / max(1e-9, sum(weight[s] for s in open_)) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            break
        full |= {s: 2.0 * size[s] for s in over}
    for s, r in by.items():
        target = full.get(s, level * weight[s])
        assert math.isclose(r[0]["target"], target, rel_tol=1e-9) and r[0]["source_size"] == size[s]
        assert abs(sum(x["taken"] for x in r) - target) <= max(x["size"] for x in r)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, rows(spark, "op1_mix", tiny)), key=str)


def test_licences(spark, tiny, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op2_licence_scan", tiny)}
    for d, t, _ in docs:
        if d != 5:
            assert got[d]["digest"] == hashlib.sha256(licences.canonical_text(t or "").encode()).hexdigest()
    mit = licences.LICENCES["MIT"]
    variants = [mit, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone, Inc.\nAll rights reserved.\n\n" + mit.upper(), "/* \n * " + mit.replace("\n", "\n * ") + "\n */", mit + " but not quite", None]
    d = spark.createDataFrame(list(enumerate(variants)), "doc_id bigint, text string")
    assert [r["licence"] for r in licences.licence_scan(d).orderBy("doc_id").collect()] == ["MIT", "MIT", "MIT", None, None]


def test_long_licence(spark):
    """A parameter text far longer than the built-in ones, with spellings that canonical() makes one."""
    text = "\n".join(f"{k}. The authors and copyright holders give this license to owner {k}, see https://example.org/{k}" for k in range(120))
    d = spark.createDataFrame([(0, text), (1, text.replace("license", "licence")), (2, text + " more")], "doc_id bigint, text string")
    assert len(licences.canonical_text(text)) > 8_000
    got = {r["doc_id"]: r for r in licences.licence_scan(d, {"Long": text}).collect()}
    assert [got[k]["licence"] for k in range(3)] == ["Long", "Long", None] and got[0]["digest"] == got[1]["digest"]


def test_shards(spark, tiny, docs):
    got = rows(spark, "op3_shard", tiny)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in docs)
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) - min(count[s] for s in range(40)) <= 1
    for s in count:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_hilbert(spark):
    from pyspark.sql import functions as F

    from lumenql.llm.sharding import hilbert_index

    d = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    r = d.select("*", hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3).alias("h")).orderBy("h").collect()
    assert [x.h for x in r] == list(range(512))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(r, r[1:], strict=False))


def test_paragraphs(spark, tiny, docs):
    got = defaultdict(list)
    for r in rows(spark, "op4_paragraph_dedup", tiny):
        got[r["doc_id"]].append(r)
    assert {300, 301, 302, 303} <= set(got) and not set(got) & {400, 401, 402, 403, 404, 406, 10}
    assert {d for d in got if d < 100} <= {*range(6), *range(20, 26)}
    assert sum(r["removed"] for d in (301, 302, 303) for r in got[d]) > 60
    assert paragraph_dedup.bands(0.8) == 3


def whole_texts(data, offsets):
    """A stand-in for paragraphs(): each text is one."""
    start, end, first = textvec.words(data, offsets)
    return np.arange(len(first) - 1), first[:-1], first[1:], start, end, textvec.word_hashes(data, start, end)


@pytest.mark.parametrize("chunk", [512, 2])
def test_paragraphs_of_one_group(spark, monkeypatch, chunk):
    """Pairs of near copies whose shingles are mostly those of all others, so that all meet in a few large groups."""

    monkeypatch.setattr(paragraph_dedup, "paragraphs", whole_texts)
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    hot = " ".join(f"hot{k}" for k in range(60))
    texts = [f"{hot} " + " ".join(f"own{k}x{j}" for j in range(7)) + end for k in range(40) for end in (" a", " b")]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)]
    links = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)}
    assert links == {(i + 1, i) for i in range(0, 80, 2)}
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    by = defaultdict(set)
    for r in got:
        by[r["cluster"]].add(r["doc_id"])
    assert sorted(map(sorted, by.values())) == [[i, i + 1] for i in range(0, 80, 2)]


def test_passages_of_lines(spark):
    """An exact passage of 80 words in lines of 3 to 10 words, and one of 20 words in a line, is found whatever is around it."""
    rng = np.random.default_rng(7)
    say = lambda n: [f"{x:06x}" for x in rng.integers(0, 1 << 24, n)]
    lines = lambda w, sizes: "\n".join(" ".join(w[b - n : b]) for n, b in zip(sizes, np.cumsum(sizes), strict=False) if w[b - n : b])
    texts = []
    for _ in range(8):
        for k in range(3, 11):
            passage = lines(say(80), [k] * 27)
            texts += ["\n".join([lines(say(60), [k] * 20), passage, lines(say(60), [k] * 20)]) for _ in range(2)]
        passage = lines(say(80), rng.integers(3, 11, 40))
        texts += ["\n".join([lines(say(60), rng.integers(3, 11, 40)), passage, lines(say(60), rng.integers(3, 11, 40))]) for _ in range(2)]
        passage = " ".join(say(20))
        texts += ["\n".join([" ".join(say(int(rng.integers(2, 7)))), passage, " ".join(say(30))]) for _ in range(2)]
    got = defaultdict(int)
    for r in paragraph_dedup.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        got[r["doc_id"]] += r["words"]
    assert sorted(got) == list(range(len(texts)))
    for data in (t.encode() for t in texts[:20]):
        _, a, b, *_ = paragraph_dedup.paragraphs(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert (b[:-1] == a[1:]).all() and a[0] == 0 and b[-1] == len(data.split())


def test_decontamination(spark, tiny):
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op5_decontaminate", tiny)}
    assert got == {(d, 1) for d in (300, 301, 302, 303)}
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    texts = [
        "Ann bought 12 red apples for 5 euros and gave 12 of them to the poor old farmer",
        "so then. Eve bought 40 red apples for 9 euros and gave 40 of them to the poor old farmer",  # other numbers, used alike
        "so then. Eve bought 40 red apples for 9 euros and gave 33 of them to the poor old farmer",  # one slot, two values
        "a text about apples and a farmer with nothing else", "1 2 3 4 5 6 7 8 9 10 11 12", None, "",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [(r["doc_id"], r["exact"]) for r in decontaminate.contaminated(d, bench).orderBy("doc_id").collect()] == [(0, True), (1, False)]
    held, decontaminate.FILTER_WINDOWS = decontaminate.FILTER_WINDOWS, 0
    try:
        assert decontaminate.contaminated(d, bench).count() == 2
    finally:
        decontaminate.FILTER_WINDOWS = held


def test_decontamination_of_short_and_dense_items(spark):
    items = ["Who wrote the old red book", "Name the capital", "12 x 34 = 408 and 56 x 78 = 4368 while 9 x 9 = 81 or 3 x 3 = 9", "Der Hund Der Katze Das Haus Am See Mit Frau Und Kind Im Garten"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [f"this page asks many things, such as {x} and then goes on for some more words" for x in items]
    texts += ["this page asks who wrote an old red book and then goes on", "12 x 35 = 420 and 56 x 79 = 4424 while 9 x 8 = 72 or 3 x 2 = 6"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()) == [(k, k) for k in range(4)]


def test_decontamination_word_for_word(spark):
    """A contradiction of slots or other capitals do not hide what agrees word for word."""
    plain = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(20))
    items = [f"so 17 pears and {plain} then 17 plums and {plain.replace('word', 'term')}", "we saw that Anna met Bert near Rome with Carl by Kiel and Dora from Bonn or Emil off Bern"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [items[0].replace("then 17", "then 19"), items[1].lower(), items[1].upper(), "we saw that " + items[1].split(" near")[0]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()) == [(0, 0), (1, 1), (2, 1)]


def cut(texts, least=200):
    count = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
    for t in texts:
        m = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                m[k : k + least] = True
        yield len(t), int(m.sum()), int((m[1:] > m[:-1]).sum() + m[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~m[:-1]].tobytes()).hexdigest()


@pytest.mark.parametrize("most", [1, 12_000])
def test_suffixes(spark, tiny, docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op6_suffix_dedup", tiny))
    assert got == sorted((d, *x) for (d, _, _), x in zip(docs, cut([(t or "").encode() for _, t, _ in docs]), strict=True))


def test_transform():
    rng = np.random.default_rng(3)
    for trial in range(60):
        least = int(rng.choice([1, 2, 5, 17, 30]))
        texts = [bytes(rng.choice(list(b"ab" if trial % 2 else b"abcd"), rng.integers(0, 60)).astype(np.uint8)) for _ in range(int(rng.integers(1, 7)))]
        count = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
        for t, found in zip(texts, suffix_dedup.repeated_windows(texts, least), strict=True):
            want = suffix_dedup.merged(np.array([k for k in range(len(t) - least + 1) if count[t[k : k + least]] > 1], np.int64), least)
            assert found == want


def test_quality(spark, tiny, docs):
    got = rows(spark, "op7_quality", tiny)
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    x = np.random.default_rng(1).random((2000, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] <= 0.7)).astype(float)
    m = quality.fit(x, y, ["a", "b", "c"])
    score = m.intercept + sum(r.weight * r.holds(x, ["a", "b", "c"]) for r in m.rules)
    assert len(m.rules) <= quality.RULES and ((score > 0) == (y > 0)).mean() > 0.97
    d = spark.createDataFrame(x[:200].tolist(), "a double, b double, c double")
    assert np.allclose([r[0] for r in d.select(m.score()).collect()], 1 / (1 + np.exp(-score[:200])))


@pytest.mark.parametrize("tile", [16, 4096])
def test_vectors(spark, tiny, monkeypatch, tile):
    monkeypatch.setattr(embedding_dups, "TILE", tile)
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, "op8_embedding_dups", tiny)}
    good = {i: np.array(v, float) for i, v in table if v and None not in v and np.isfinite(v).all() and any(v)}
    link = {(i, j) for i in good for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / math.sqrt(good[i] @ good[i]) / math.sqrt(good[j] @ good[j]) >= 0.95}
    root = {i: i for i, _ in table}
    for _ in range(50):
        for i, j in link:
            root[i] = min(root[i], root[j])
    assert got == {i: (sum(a == i for a, _ in link), root[i], root[i] == i) for i, _ in table}
    assert len(link) > 100


def classes(docs, width, num, den):
    sets = []
    for _, t, _ in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    up = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            n = len(x & sets[j])
            if n and den * n >= num * (len(x) + len(sets[j]) - n):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    return sets, [min(docs[k][0] for k in range(len(docs)) if up[k] == up[i]) for i in range(len(docs))]


@pytest.mark.parametrize(("chunk", "local"), [(512, 64), (2, 1)])
def test_jaccard(spark, tiny, docs, monkeypatch, chunk, local):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 8 * chunk)
    monkeypatch.setattr(jaccard_join, "LOCAL", local)
    sets, root = classes(docs, 3, 9, 10)
    got = sorted(map(tuple, QUERIES["op9_jaccard_join"](spark, tiny).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted((d[0], len(s), r) for d, s, r in zip(docs, sets, root, strict=True))


def test_jaccard_without_ids(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(6)]
    d = spark.createDataFrame([(None, t + end) for t in texts[:5] for end in (" a", " b")] + [(1, texts[5]), (None, texts[5] + " c")], "doc_id bigint, text string")
    got = Counter(r["root"] for r in jaccard_join.jaccard_classes(d).collect())
    assert sorted(got.values()) == [2] * 6


def test_pages(spark, tiny):
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows(spark, "op10_html_extract", tiny))
    text = "Title & more Some long text here, which goes on. And a second paragraph of the article."
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "unclosed bold", 13), (4, "unclosed bold", 13)]
    page = "<div><ul><li><a href=x>One</a></ul></div><div><h2>Head</h2><p>Some long text, on and on and on and on.</div><div class='comments'><p>I agree with every word of this.</div><script>x</script>"
    assert html_extract.main_text(page) == "Head Some long text, on and on and on and on."


@pytest.mark.parametrize("name", ["site-content has-sidebar", "no-sidebar", "with-header", "long-form", "comments-open", "social-science", "legal", "form", "page-header"])
def test_named_wrappers(name):
    text = "A long paragraph of the article that goes on and on, with one thing after another and no links at all."
    more = "<div class='main-nav'><a href=x>Home</a> and here</div><div class='comments-list'><p>I agree.</div>"
    assert html_extract.main_text(f"<body><div id='top'><a href=y>Logo</a></div><div class='{name}'><h1>Head</h1><p>{text}</p><p>{text}</p>{more}</div></body>") == f"Head {text} {text}"
    long = f"<div class='comments'><p>{text * 9}</div>"
    assert html_extract.main_text(f"<body><div><h1>Head</h1><p>{text}</p></div>{long}</body>") == f"Head {text}"


def density(page: str):
    """Composite density and child sums of a small well-formed page by the formula alone, as {id: (density, sum)}."""
    tree = ElementTree.fromstring(page)

    def counts(x):
        inside = [counts(k) for k in x]
        own = [x.text or "", *[k.tail or "" for k in x]]
        c = sum(len("".join(t.split())) for t in own) + sum(i[0] for i in inside)
        links = c if x.tag == "a" else sum(i[1] for i in inside)
        return c, links, sum(i[2] for i in inside) + len(x) - sum(k.tag == "b" for k in x), sum(i[3] for i in inside) + sum(k.tag == "a" for k in x)

    whole, out = counts(tree), {}

    def visit(x):
        c, lc, t, lt = counts(x)
        base = math.log(max(1.0, c / max(1, c - lc) * lc + whole[1] / max(1, whole[0]) * c) + math.e)
        d = c / max(1, t) * math.log(1 + c / max(1, lc) * max(1, t) / max(1, lt)) / math.log(max(1.0, base) + 1) if c > lc else 0.0
        below = [visit(k) for k in x]
        own = sum(len("".join(v.split())) for v in [x.text or "", *[k.tail or "" for k in x]])
        out[x.get("id")] = d, own + sum(below)
        return d

    visit(tree)
    return out


def test_densities():
    """On generated pages densities and the chosen subtree are those of the formula, and the article's words come out."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n))
    hits = misses = extra = 0
    for _ in range(50):
        number = iter(range(10_000))
        tag = lambda t, body: f'<{t} id="x{next(number)}">{body}</{t}>'  # noqa: B023, E731
        links = lambda n: tag("ul", "".join(tag("li", tag("a", say(rng.randint(1, 3)))) for _ in range(n)))  # noqa: B023, E731
        article = [tag("h2", say(5)), *[tag("p", say(rng.randint(25, 90)) + " " + tag("b", say(2)) + " " + say(3)) for _ in range(rng.randint(4, 9))]]
        page = tag("div", tag("div", links(rng.randint(3, 12))) + tag("div", tag("div", "".join(article)) + tag("div", links(rng.randint(2, 6)))) + tag("div", tag("p", say(4)) + links(3)))
        want = density(page)
        root = html_extract.parse(page)
        order = html_extract.densities(root)
        got = sorted((round(x.density, 9), round(x.total, 9)) for x in order if x.tag != "#root")
        assert got == sorted((round(d, 9), round(t, 9)) for d, t in want.values())
        text = set(html_extract.main_text(page).split())
        mine = {w for x in article for w in re.sub(r"<[^>]*>", " ", x).split()}
        hits, misses, extra = hits + len(mine & text), misses + len(mine - text), extra + len(text - mine)
    assert hits / (hits + misses) > 0.98 and hits / (hits + extra) > 0.98


def test_pages_of_the_driver(spark):
    """Precision and recall of words on the synthetic pages, whose articles stand in an element of that name."""
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not there")
    for r in html_extract.extract(spark.read.parquet(path)).join(spark.read.parquet(path), "page_id").collect():
        article = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]))
        assert r["text"].split() == html.unescape(article).split()


def test_crafted_pages():
    """Long pages of unclosed, deep, stray and unquoted tags take time in proportion to their length, and nothing fails."""
    for page in ('<div class="a>' + '<p>text "' * 60_000, "<div><b>" * 50_000 + "text", "<div>" * 2_000 + "</x>" * 200_000 + "text", "<li><p>" * 50_000 + "text", "<" * 300_000, "&amp;" * 100_000):
        began = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - began < 30


@pytest.mark.parametrize("dim", [1, 2, 8, 16, 17, 64])
def test_vector_dimensions(spark, monkeypatch, dim):
    """Brute force at several dimensions, with tiny and huge components, and tiles of few vectors."""
    monkeypatch.setattr(embedding_dups, "TILE", 32)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    v = np.concatenate([base, base[:30] + rng.normal(size=(30, dim)) * 0.12, base[:10] * 1e200, base[10:20] * 1e-200, base[:5]])
    table = list(enumerate(v.tolist()))
    rng.shuffle(table)
    unit = v / np.abs(v).max(1)[:, None]
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.minimum(root, np.where(link, root[None, :], len(v)).min(1))
    d = spark.createDataFrame([(int(i), x) for i, x in table], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dups.near_vectors(d, 0.95).collect()}
    assert got == {i: (int(link[i].sum()), int(root[i])) for i in range(len(v))}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_shuffled_once(spark, monkeypatch, kind):
    """What is shuffled grows with the vectors, though nearly all pairs of tiles meet, and links are those of brute force."""
    monkeypatch.setattr(embedding_dups, "TILE", 25)
    monkeypatch.setattr(embedding_dups, "ROWS", 8)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 24))
    v[300:420] = v[:120] + rng.normal(size=(120, 24)) * 0.2
    v[420:700] = v[rng.integers(0, 300, 280)]
    v = v.astype(np.float32).astype(float) if kind == "float" else v
    spark.createDataFrame(list(enumerate(v.tolist())), f"vec_id bigint, embedding array<{kind}>").createOrReplaceTempView("vectors_once")
    unit = v / np.sqrt((v**2).sum(1))[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(v))
    for _ in range(50):
        root = np.minimum(root, np.where(link, root[None, :], len(v)).min(1))
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    d = spark.table("vectors_once")
    before = shuffled()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dups.near_vectors(d, 0.95).collect()}
    assert got == {i: (int(link[i].sum()), int(root[i])) for i in range(len(v))}
    assert shuffled() - before < 6 * v.nbytes


def test_small_batches_of_texts(spark, tiny, monkeypatch):
    """The first two stages of the pipeline send few rows and bytes to Python at a time, and leave the session as it was."""
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before, seen = [spark.conf.get(n) for n in names], {}
    for module in (quality, jaccard_join):

        def noted(df, name="part", *more, land=module.land):
            seen[name] = [int(spark.conf.get(n).rstrip("b")) for n in names]
            return land(df, name, *more)

        monkeypatch.setattr(module, "land", noted)
    d = corpus_pipeline.quality(spark, spark.read.parquet(f"{tiny}/documents.parquet"), tiny)
    corpus_pipeline.near_duplicates(spark, d, tiny).count()
    assert all(seen[n][0] <= 1000 and seen[n][1] <= 4_000_000 for n in ("stats", "frequent", "sets"))
    assert [spark.conf.get(n) for n in names] == before


def test_jaccard_of_long_sets(spark):
    """Links at 0.8 of sets of 500 to 5000 shingles, with passages that many share and copies near the threshold."""
    rng = random.Random(9)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    shared = say(400)
    texts = []
    for n in (30, 120, 500, 1500, 5000):
        for _ in range(6):
            base = say(n)
            texts.append(base)
            for share in (0.01, 0.03, 0.05, 0.2):
                copy = list(base)
                for k in rng.sample(range(n), max(1, int(share * n / 5))):
                    copy[k] = say(1)[0]
                texts.append(copy)
            texts.append(shared + say(n))
            texts.append(shared + base[: n // 2])
    docs = [(i, " ".join(t), None) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    _, root = classes(docs, 5, 4, 5)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.named(jaccard_join.jaccard_classes(d, 5, 4, 5)).collect()}
    assert got == {x[0]: r for x, r in zip(docs, root, strict=True)}
    assert 10 < len(set(root)) < len(docs)


def test_order_of_tokens(spark, monkeypatch):
    """The order puts tokens of many sets last, keeps to its size, and any order links the same sets."""
    texts = [f"one two three four five six own{k} end{k}" for k in range(64)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    order = jaccard_join.token_order(d, 3, 5)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    start, end, _ = textvec.words(data, np.array([0, len(data)]))
    levels = order.levels(textvec.window_hashes(textvec.word_hashes(data, start, end), 3))
    assert (levels[:4] == 6).all() and (levels[4:] == 0).all()
    before = sorted(map(tuple, jaccard_join.jaccard_classes(d).collect()))
    monkeypatch.setattr(jaccard_join, "FILTER_ENTRIES", 0)
    assert jaccard_join.token_order(d, 3, 5).levels(np.arange(100, dtype=textvec.U)).max() == 0
    assert sorted(map(tuple, jaccard_join.jaccard_classes(d).collect())) == before


def test_quality_held_out(spark):
    """Floors on the fold that was not learned from, and scores that are those of the rules."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not there")
    got = {r["doc_id"]: r for r in rows(spark, "op7_quality", path)}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [(got[d]["score"], got[d]["predicted"], q) for d, q in label.items() if q is not None and d in got and got[d]["held_out"]]
    good, bad = ([s for s, _, q in held if q == v] for v in (1, 0))
    area = sum((x > y) + 0.5 * (x == y) for x in good for y in bad) / (len(good) * len(bad))
    assert len(held) > 40 and area > 0.97 and sum(p == q for _, p, q in held) / len(held) > 0.93


def test_decontamination_by_brute_force(spark):
    """Word for word passages of plain words, against all pairs of windows."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.choice([3, 6, 8, 15, 40, 80])) for _ in range(25)]
    texts = []
    for _ in range(120):
        item = rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : a + rng.choice([4, 8, 12, 13, 20, 60])]
        if rng.random() < 0.3 and len(part) > 10:
            part[len(part) // 2] = "changed"
        texts.append(say(rng.randint(0, 30)) + part + say(rng.randint(0, 30)) + (part if rng.random() < 0.2 else []))
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            size = min(8, len(item))
            found = defaultdict(set)
            for p in range(len(t) - size + 1):
                for q in range(len(item) - size + 1):
                    if t[p : p + size] == item[q : q + size]:
                        found[p - q] |= set(range(q, q + size))
            longest = 0
            for covered in found.values():
                for q in covered:
                    n = 0
                    while q + n in covered:
                        n += 1
                    longest = max(longest, n)
            words = len(set().union(*found.values()))
            if longest >= 13 or words and words >= len(item) / 2:
                want.add((d, i, words))
    frame = lambda name, x: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(x)], f"{name} bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["words"]) for r in decontaminate.contaminated(frame("doc_id", texts), frame("item_id", items)).collect()}
    assert got == want and 30 < len(want) < 120


def test_paragraph_recall(spark):
    """Pairs of paragraphs at the threshold or above, among many others, come together with the recall that is asked for."""
    rng = random.Random(6)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    pairs, texts = [], []
    while len(pairs) < 400:
        base = say(rng.randint(40, 90))
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(len(copy))] = say(1)[0]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, copy))
        if 5 * len(x & y) >= 4 * len(x | y):
            pairs.append((len(texts), len(texts) + 1))
            texts += [base, copy]
    held = paragraph_dedup.paragraphs
    paragraph_dedup.paragraphs = whole_texts
    try:
        got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    finally:
        paragraph_dedup.paragraphs = held
    by = defaultdict(set)
    for r in got:
        by[r["cluster"]].add(r["doc_id"])
    found = {tuple(sorted(v)) for v in by.values()}
    assert found <= set(pairs) and len(found) >= 0.98 * len(pairs)


def test_pipeline(spark, tiny, docs):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, d, tiny).collect()
    _, root = classes(docs, 5, 4, 5)
    assert sorted(r["doc_id"] for r in kept) == sorted({(x[0], x[1]) for x in docs if (x[0] in root and x[0] == root[docs.index(x)])} and [x[0] for x in sorted({(x[0], x[1] or "") for x, r in zip(docs, root, strict=True) if r == x[0] and (x[1] or "").strip()})] + [x[0] for x in docs if not (x[1] or "").strip()])
    clean = corpus_pipeline.decontamination(spark, d, tiny)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(x[0] for x in docs if x[0] not in (300, 301, 302, 303))
    out = corpus_pipeline.run(spark, tiny)
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
