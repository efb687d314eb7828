"""Very long texts, empty tables, nulls and columns of other names."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapwing.llm import bytewords as bw
from lapwing.llm import html_text, mixing, near_dedup, quality, sharding, token_ids, tool_calls, toxicity
from lapwing.llm.decontaminate import contamination
from lapwing.llm.line_quality import quality_rules
from lapwing.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_text():
    """Above a chunk and several pieces, of words of all lengths, one of them longer than a piece, and letters of several bytes."""
    rng = random.Random(20)
    some = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    parts = [rng.choice(some) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(150_000)]
    parts.insert(70_000, "x" * (bw.PIECE + 1000) + " ")
    return "".join(parts)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_words_of_long_texts(long_text):
    col = pa.array(["a b", None, long_text, "", "end"])
    assert len(long_text.encode()) > bw.CHUNK + bw.PIECE
    n = {}
    for a, b, buf, offs in bw.chunks(col):
        row, begin, size, h = bw.find_words(buf, offs)
        for r in range(b - a):
            at = row == r
            n[a + r] = [bytes(buf[i : i + k]).decode() for i, k in zip(begin[at], size[at], strict=True)] if a + r == 2 else int(at.sum())
            if a + r == 2:
                same = dict(zip(h[at].tolist(), n[2], strict=True))
                assert len(same) == len(set(n[2]))
    assert n == {0: 2, 1: 0, 2: plain_words(long_text), 3: 0, 4: 1}


def test_operators_on_a_long_text(spark, long_text):
    rows = [(1, long_text), (2, long_text + " tail"), (3, "short one")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    words = plain_words(long_text)
    near = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    assert near[1]["n_shingles"] == len({tuple(low[i : i + 5]) for i in range(len(low) - 4)}) and near[2]["component_id"] == 1
    rules = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert (rules[1]["n_words"], rules[1]["word_chars"]) == (len(words), sum(map(len, words)))
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in tri:
        count[w] = count.get(w, 0) + 1
    again = {i + j for i, w in enumerate(tri) if count[w] > 1 for j in range(3)}
    assert rules[1]["n_repeat_words"] == len(again)
    item = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", long_text.lower())[-14:]
    found = contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"]: r["n_hit"] >= 14 for r in found.collect()} == {1: True, 2: True, 3: False}
    mix = {r["doc_id"]: r["size"] for r in mixing.Mixture(docs).by_document().collect()}
    assert mix == {1: len(words), 2: len(words) + 1, 3: 2}
    ids = token_ids.encoder(vocabulary()).whole.encode(long_text, add_special_tokens=False).ids + [2]
    got = {r["doc_id"]: r for r in token_ids.token_files(docs, vocabulary()).collect()}
    assert (got[1]["n_tokens"], got[1]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b c", "en", "s", None), (None, None, None, None, None)], DOCS)
    for d in (docs, some):
        model = toxicity.fit_toxicity(d, labels)
        scores = [r["score"] for r in toxicity.toxicity(d, model).collect()]
        assert len(scores) == d.count() and all(0 <= s < 0.7 for s in scores)
        assert toxicity.without_toxic(d, model).count() == d.count()
        scores = [r["score"] for r in quality.quality(d, labels, F.lit(True)).collect()]
        assert scores == [0.5] * d.count()
        assert sharding.balanced_shards(d).count() == d.count()
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_columns_of_clashing_names(spark):
    rng = random.Random(3)
    names = ["h", "toxic", "quality", "score", "rk", "host", "stream", "keys", "shard", "g", "klass", "bands", "node", "bucket", "tk", "start", "size", "n_words", "lines", "row", "spans", "id", "hash", "number", "_b", "_w"]
    rows = [(i, " ".join(rng.choice("abcdefghijklm") * rng.randint(2, 6) for _ in range(30)), "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs.select("*", *[F.lit("x").alias(c) for c in names])
    labels = spark.createDataFrame([(i, i % 2, i % 2, "y") for i in range(12)], "doc_id long, quality int, toxic int, text string")
    key = lambda df: sorted(map(str, df.collect()))
    model = toxicity.fit_toxicity(docs, labels.drop("text"))
    for run in (
        lambda d: toxicity.toxicity(d, toxicity.fit_toxicity(d, labels)),
        lambda d: toxicity.without_toxic(d, model).select("doc_id", "text"),
        lambda d: quality.quality(d, labels, F.col("doc_id") < 9),
        lambda d: near_dedup.near_duplicates(d),
        lambda d: quality_rules(d),
        lambda d: sharding.balanced_shards(d, 3),
        lambda d: mixing.Mixture(d, block=8).texts(d).select("doc_id", "text"),
    ):
        assert key(run(docs)) == key(run(wide))
    pages = spark.createDataFrame([(i, f"http://h/{i % 2}", f"<p>{t}") for i, t, *_ in rows], "page_id long, url string, html string")
    assert key(html_text.main_text(pages)) == key(html_text.main_text(pages.select("*", *[F.lit(1).alias(c) for c in names], F.lit(2).alias("text"))))
    turns = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(6)], "conv_id long, turn long, role string, text string")
    out = []
    for t in (turns, turns.select("*", *[F.lit(1).alias(c) for c in ("at", "level", "due", "c", "r", "status", "rules", "types", "v")])):
        calls, results = tool_calls.calls_of_turns(t)
        more = [F.lit(1).alias(c) for c in ("at", "level", "status", "rules")]
        out.append(key(tool_calls.link_tool_calls(calls.select("*", *more), results.select("*", *more), tool_calls.chat_schemas(spark))))
    assert out[0] == out[1]


def test_mirrored_pages_keep_their_text(spark):
    """Three urls with one undeclared article are copies; runs that pages of different streams share still go."""
    from lapwing.llm import html_text

    article = " ".join(f"word{i}" for i in range(30))
    footer = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"https://a.example/{i}", f"<body><div>{article}</div></body>") for i in range(3)]
    rows += [(10 + i, f"https://b.example/{i}", f"<body><div>own{i} text{i} here{i}</div><div>{footer}</div></body>") for i in range(3)]
    rows += [(20, "https://b.example/only", f"<body><div>{footer}</div></body>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [article] * 3
    assert [got[10 + i] for i in range(3)] == [f"own{i} text{i} here{i}" for i in range(3)]
    assert got[20] == footer
