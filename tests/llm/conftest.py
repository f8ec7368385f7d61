import random

import pytest
from pyspark.sql import types as T


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    """A folder of tables with nulls, empty texts, ties, repeated rows, near copies and columns with clashing names."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = words(rng, 60)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "z", None])) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "a") for i in range(6)]  # exact copies
    rows += [(200 + i, base[20 + i] + " end", "en", "b") for i in range(6)]  # near copies
    rows += [(300 + i, words(rng, 40) + " " + passage + " " + words(rng, 40), "en", "b") for i in range(4)]
    rows += [(400, None, "en", "a"), (401, "", None, None), (402, " \t\n ", "en", "z"), (403, "one", "en", "z"), (404, "One", "en", "z"), (405, "ünï cödé wörds çà là", "fr", "b"), (405, "ünï cödé wörds çà là", "fr", "b"), (406, words(rng, 20000), "en", "b"), (5, "another text with the id of five", "en", "a")]
    path = str(tmp_path_factory.mktemp("tiny"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("n", T.LongType()), T.StructField("root", T.LongType())])
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 2) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(1, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "Ann bought 12 red apples for 5 euros and gave 12 of them to the poor old farmer"), (3, None), (4, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    vec = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(60)]
    vectors = list(enumerate(vec)) + [(100 + i, vec[0]) for i in range(5)] + [(200 + i, [x + rng.gauss(0, 0.1) for x in vec[1]]) for i in range(40)] + [(300, None), (301, []), (302, [0.0] * 20), (303, [float("nan")] * 20), (304, [None] + [1.0] * 19), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    html = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>Some long\n text <b>here</b>, which goes on.<p>And a second paragraph of the article.</article><footer>(c) me</footer></body></html>"
    spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", ""), (4, None, "<p>unclosed <b>bold"), (4, None, "<p>unclosed <b>bold")], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tiny, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{tiny}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path
