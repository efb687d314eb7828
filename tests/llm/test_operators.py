"""Edge cases and brute-force versions of the training-data operators."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapwing.llm import html_text, mixing, near_dedup, token_ids, tool_calls, toxicity
from lapwing.llm.decontaminate import contamination
from lapwing.llm.common import hash_sample
from lapwing.llm.line_quality import frequent_lines, line_statistics, quality_rules, without_lines
from lapwing.llm.quality import quality, train_rules
from lapwing.llm.queries import vocabulary
from lapwing.llm.sharding import balanced_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long, klass string, words string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y") for i, t, s in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = words(rng, 60)
    rows = [(1, base, "a"), (2, base, "a"), (3, base.replace(" ", "\n", 3) + " tail", None), (4, None, "b"), (5, "", "b"), (6, "One two", "b"), (7, "one TWO", "c"), (8, words(rng, 3000), "a"), (8, words(rng, 20), "a"), (None, words(rng, 30), None), (9, "é ñ 漢字 <|endoftext|> I'M #2#", "c")]
    return rows + [(10 + i, words(rng, 40), "a") for i in range(30)]


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(make(spark, corpus)).collect()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert len(got) == len(corpus)
    assert [by[k]["component_id"] for k in ((1, 56), (2, 56), (3, 57))] == [1, 1, 1]
    assert by[(4, 0)]["kept"] and by[(5, 0)]["component_id"] == 5
    assert by[(6, 1)]["component_id"] == by[(7, 1)]["component_id"] == 6 and not by[(7, 1)]["kept"]
    assert near_dedup.near_duplicates(make(spark, [])).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """A group in which most pairs are not similar enough, but neighbours are."""
    rng = random.Random(3)
    w = words(rng, 100).split()
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(w), "a"))
        w = w[1:] + [words(rng, 1)]
    got = near_dedup.near_duplicates(make(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {89}


def test_shingles_are_alike_in_chunks_of_any_rows():
    text = words(random.Random(7), 40)
    alone = next(near_dedup.shingle_sets(pa.array([text]), 5))[4]
    for others in (1, 30, 500):
        got = next(near_dedup.shingle_sets(pa.array([text] + ["one more text"] * others), 5))
        assert set(got[4][got[5] == 0]) == set(alone)


def test_contamination(spark, corpus):
    item = " ".join(corpus[0][1].split()[20:35])
    items = spark.createDataFrame([(3, item, 1), (11, "ONE, two!", 1), (12, None, 1), (13, "", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["n_words"]): r for r in contamination(make(spark, corpus), items).collect()}
    assert (got[(1, 60)]["n_hit"], got[(1, 60)]["n_items"]) == (15, 1)
    assert got[(6, 2)]["n_hit"] == 2 and got[(4, 0)]["contaminated"] is False
    assert contamination(make(spark, corpus), items.limit(0)).where("contaminated").count() == 0
    assert contamination(make(spark, []), items).count() == 0


def test_quality_rules(spark, corpus):
    line = "subscribe to our letter now"
    rows = corpus + [(100 + i, f"{line} {i % 3}\n" + "word%d x" % i, "host") for i in range(90)]
    got = {r["doc_id"]: r for r in quality_rules(make(spark, rows), min_words=3).collect()}
    assert got[100]["n_removed_words"] == 6 and got[100]["kept"] is False
    assert got[4]["n_words"] == 0 and got[4]["base_failed"]
    assert quality_rules(make(spark, [])).count() == 0


def test_lines_of_copies_count_once_and_lines_go(spark):
    line = "all rights reserved"
    rows = [(i, f"own words {i}\n{line}", "h") for i in range(30)] + [(5, f"other text\n{line}", "g"), (5, None, "h"), (6, "", None)] + [(200 + i, "one text\nof copies", "h") for i in range(50)]
    docs = make(spark, rows)
    stats = line_statistics(docs)
    often = frequent_lines(stats, 20, 0.02)
    assert [(r["host"], r["texts"]) for r in often.collect()] == [("h", 30)]
    got = without_lines(docs.withColumn("tk", F.lit(1)).withColumn("line", F.lit("x")).withColumn("row", F.lit(2)), stats, often)
    assert got.columns == [*docs.columns, "tk", "line", "row"]
    want = [(i, t if t is None or h != "h" else t.removesuffix("\n" + line), h) for i, t, h in rows]
    assert sorted((r["doc_id"], str(r["text"]), str(r["source"])) for r in got.collect()) == sorted((i, str(t), str(h)) for i, t, h in want)


def test_mixing(spark, corpus):
    docs = make(spark, corpus * 3)
    m = mixing.Mixture(docs, block=16)
    rows = m.by_document().collect()
    assert len(rows) == 3 * len(corpus)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    per = {}
    for r in rows:
        a = per.setdefault(r["source"], [r["source_size"], r["target"], 0])
        a[2] += r["taken"]
    assert all(abs(t - k) <= 0.5 for _, t, k in per.values())
    sizes = sorted(((s is None, s or ""), v[0], v[1]) for s, v in per.items())
    assert sum(v[1] for v in per.values()) == pytest.approx(1.5 * sum(v[0] for v in per.values()))
    weights = [3, 1, 2]
    level = [t / weights[i % 3] for i, (_, s, t) in enumerate(sizes) if t < 2 * s - 1e-6]
    assert max(level) == pytest.approx(min(level))
    texts = m.texts(docs.withColumn("tk", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("row", F.lit("y")).withColumn("id", F.lit(2))).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in texts) == sum(r["taken"] for r in rows)
    assert mixing.Mixture(make(spark, [])).by_document().count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Excess over the caps handed out again and again until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and rest > 1e-9:
        level = rest / sum(w[s] for s in free)
        target.update({s: target[s] + level * w[s] for s in free})
        rest = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        target = {s: min(t, most * sizes[s]) for s, t in target.items()}
        free = {s for s in free if target[s] < most * sizes[s] - 1e-9}
    return target


def test_targets_against_plain_resharing(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000, 100_000]) for i in range(n)} | ({None: 77} if n > 2 else {})
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = plain_targets(sizes)
        assert {r["source"] for r in got} == set(sizes)
        assert all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_shards_draw_sources_by_their_targets(spark):
    """Every shard has its number of slots, their totals meet the targets, and a shard's counts scatter as draws do."""
    rng = random.Random(8)
    docs = make(spark, [(i, words(rng, 60), "abc"[i % 3]) for i in range(900)])
    m = mixing.Mixture(docs, block=16, shard_words=16 * 64)
    counts = m.counts.collect()
    total = {}
    for r in counts:
        total.setdefault(r["shard"], {})[r["source"]] = r["slots"]
    slots = sum(r["slots"] for r in counts)
    assert sorted(total) == list(range(-(-slots // 64)))
    assert all(sum(c.values()) == 64 for b, c in total.items() if b < max(total))
    for source, p in ((s, sum(c.get(s, 0) for c in total.values()) / slots) for s in "abc"):
        got = np.array([c.get(source, 0) for b, c in total.items() if b < max(total)])
        assert abs(got.mean() - 64 * p) < 1
        assert 0.4 < got.var() / (64 * p * (1 - p)) < 2
    again = mixing.Mixture(docs.repartition(7), block=16, shard_words=16 * 64).slots
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(again) == key(m.slots)


def test_permutation_is_one(spark):
    x = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(7).cast("long"), F.lit(1000).cast("long")).alias("p"))
    assert sorted(r["p"] for r in x.collect()) == list(range(1000))


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = token_ids.token_files(make(spark, corpus), vocabulary(), shard_tokens=300).orderBy("start").collect()
    want = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    start = 0
    for r, (i, text, _) in zip(got, want, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        if i != 8:  # two texts share this id
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += r["n_tokens"]
    assert token_ids.token_files(make(spark, []), vocabulary()).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, n).astype("<u4") for n in (0, 1, 5000, 3, 20000)] + [np.full(999, 2, "<u4")]
    g = token_ids.Grammar(token_ids.compress(docs, 2))
    for k, d in enumerate(docs):
        assert g.ids(k).tolist() == [*d.tolist(), 2] and g.count(k) == len(d) + 1
    assert len(g.left) > 0


def plain_re_pair_counts(x, end):
    """Occurrences of each pair without overlaps, counted from the left."""
    n, last = {}, {}
    for i in range(len(x) - 1):
        p = (x[i], x[i + 1])
        if end not in p and last.get(p, -2) < i - 1:
            n[p], last[p] = n.get(p, 0) + 1, i
    return n


@pytest.mark.parametrize("ids", [3, 40, 60_000])
def test_no_pair_is_left_twice(ids):
    rng = np.random.default_rng(ids)
    text = rng.integers(0, ids, 4000)
    docs = [text[rng.integers(0, 3000) :][:900].astype("<u4") for _ in range(30)] + [np.full(50, 1, "<u4"), np.zeros(0, "<u4")]
    g = token_ids.Grammar(token_ids.compress(docs, 2))
    assert all(g.ids(k).tolist() == [*d.tolist(), 2] for k, d in enumerate(docs))
    assert max(plain_re_pair_counts(g.symbols.tolist(), g.base - 1).values(), default=1) == 1
    assert len(g.left) and len(g.symbols) < sum(map(len, docs))


def test_encoder_equals_the_tokenizer():
    enc = token_ids.Encoder(vocabulary())
    rng = random.Random(4)
    odd = ["I'm", "don't", "a1b2", "É", "ÀÉ,", "e\u0301", "\u201ca\u201d,", "<|endoftext|>", "<|x", "x\u00a0y", "漢字", "!!!", "'s", "ß", "İ", "a,b", "#2#", "\x85", "\u2028"]
    for _ in range(400):
        text = rng.choice([" ", "\n", "\t"]).join(rng.choice(odd) + rng.choice(["", "", ".", ",,"]) for _ in range(rng.randint(0, 9)))
        assert enc.ids(text).tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_sharding(spark, corpus):
    rows = corpus + [(1000 + i, "a copy", "a") for i in range(40)]
    got = balanced_shards(make(spark, rows), shards=5).collect()
    n = {}
    for r in got:
        n.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and max(map(len, n.values())) - min(map(len, n.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in n.values())
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["size"], first["text_crc32"]) == (len(corpus[0][1]) + 1, zlib.crc32(corpus[0][1].encode()))
    copies = [r for r in got if r["text_crc32"] == zlib.crc32(b"a copy")]
    assert len({r["shard"] for r in copies}) <= -(-len(copies) // (len(rows) // 5)) + 1
    for r in got:
        assert r["cut_links"] == sum(o["text_crc32"] == r["text_crc32"] and o["shard"] != r["shard"] for o in got)
    types = dict(balanced_shards(make(spark, rows)).dtypes)
    assert types["slot"] == "bigint" and types["shard"] == "int" and types["grown_shard"] == "int"
    assert balanced_shards(make(spark, [])).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "f", '{"y": 1, "x": "é"}', []), (1, 2, "b", "f", '{"x": 3}', ["a"]), (1, 4, "c", "g", "nope", ["zzz"]), (1, 5, None, "f", None, None), (None, 1, "a", "f", "{}", None)],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 3, "b", "B"), (1, 1, "a", 'say "A"'), (1, 9, "q", None), (None, 2, "a", "n")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "bigint", False)], "name string, param string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert len(got) == 7
    a = got[(1, "a", "linked")]
    assert a["valid"] and a["json"] == '{"arguments":{"x":"é","y":1},"id":"a","name":"f","result":"say \\"A\\""}'
    assert got[(1, "b", "linked")]["errors"] == ["type x"] and got[(1, "b", "linked")]["position"] == 1
    c = got[(1, "c", "unanswered")]
    assert c["errors"] == ["tool"] and not c["ordered"]
    assert got[(1, "q", "orphan")]["errors"] == ["call"]
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_tool_calls_in_topological_order(spark):
    """Needs within a turn, of later turns and along a chain, in a cycle, and of itself."""
    rows = [(1, 0, "b", ["z"]), (1, 0, "z", []), (1, 2, "early", ["late", "b"]), (1, 2, "after", ["early"]), (1, 5, "late", ["z"]), (1, 9, "end", ["after"])]
    rows += [(2, 0, "a", ["b"]), (2, 1, "b", ["a"]), (2, 2, "c", []), (2, 3, "self", ["self"]), (2, 4, "d", ["c"]), (2, 4, "e", ["gone"])]
    calls = spark.createDataFrame([(c, t, i, "f", "{}", d) for c, t, i, d in rows], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "string", False)], "name string, param string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert sorted((k[1] for k in got if k[0] == 1), key=lambda i: got[(1, i)]["position"]) == ["z", "b", "late", "early", "after", "end"]
    assert all(got[(1, i)]["ordered"] and got[(1, i)]["valid"] for _, _, i, _ in rows[:6])
    assert {k[1] for k, r in got.items() if k[0] == 2 and not r["ordered"]} == {"a", "b", "self", "e"}
    assert sorted(r["position"] for k, r in got.items() if k[0] == 2) == list(range(6))


def test_html(spark):
    page = "<html><body><header>Top</header><nav>Menu</nav><article><h1>T &amp; x</h1><p>one<br>two <b>b</b>c<div class='comments'><p>hi</p></div><form>zz</form></article><aside>s</aside><script>x</script></body>"
    plain = "<body><div>{0}</div><div>all rights reserved by the owner of this very site</div></body>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/2", ""), *[(10 + i, f"http://k/{i}", plain.format(f"page {i} has its own words " + words(random.Random(i), 9))) for i in range(4)]]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "T & x one two bc" and got[1]["n_chars"] == 16
    assert got[2]["text"] == got[3]["text"] == ""
    assert got[11]["text"] == "page 1 has its own words " + words(random.Random(1), 9)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>a b</p></article></div>", "a b"),
        ("<div class='sidebar-layout'><article>a<p>b</article><div>c</div></div>", "a b"),
        ("<form><article>a b</article><input></form>", "a b"),
        ("<article>x</article><article class='comment'>y</article><div id=comments><article>z</article></div>", "x"),
        ("<aside><article>y</article></aside><article>x</article>", "x"),
        ("<article>a<select><option>b<p>c</article>", "a b c"),
        ("<article>a<object data=x>b</article>", "ab"),
        ("<article>a<title>b</article>", "ab"),
        ("<article>a<svg/>b</article>", "ab"),
        ("<article>a<script>b</article>", "a"),
        ("<article>1 &lt; 2 &amp;amp; &#x27;q&#39; <b title='>'>c</b></article>", "1 < 2 &amp; 'q' c"),
        ("<article>a <a href=\"x>b</a> c</article>", "a b c"),
        ("<article>a<!-- x", "a"),
        ("<article>3 < 4 <", "3 < 4 <"),
        ("", ""),
    ],
)
def test_article_text(page, text):
    assert " ".join(t for t, a, m in html_text.page_blocks(page) if m and not a).replace("  ", " ") == text


def test_long_odd_pages_take_linear_time():
    import time

    for page in ('<a "' * 60_000, "<div>" * 60_000 + "x", "<b class='x'>" * 60_000, "<!--" * 60_000, "<p><i></p>" * 60_000, "<a '\">" * 60_000):
        began = time.process_time()
        html_text.page_blocks(page)
        assert time.process_time() - began < 6


def test_repeated_runs_against_a_plain_search(spark):
    """Pages without an article: tokens in a substring of 8 or more that 3 pages of the host share go, all others stay."""
    rng = random.Random(12)
    shared = [words(rng, n).split() for n in (5, 8, 9, 20, 30)]
    pages = []
    for i in range(24):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(words(rng, rng.randint(1, 12)).split() if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 3) :])
        pages.append((i, f"http://h{i % 2}.x/{i}" if i != 7 else None, parts))
    pages += [(100, "http://h0.x/0", pages[0][2]), (100, "http://h0.x/0", pages[0][2]), (101, None, [])]
    make_page = lambda parts: "<body>" + "".join(f"<p>{' '.join(p)}</p>" for p in parts)
    streams = {(i, u): [t for p in parts for t in p] for i, u, parts in pages}
    host = lambda u: u.split("/")[2] if u else ""

    def plain(i, u):
        own, gone = streams[(i, u)], set()
        for a in range(len(own)):
            for b in range(a + 8, len(own) + 1):
                part = own[a:b]
                n = len({tuple(x) for (_, v), x in streams.items() if host(v) == host(u) and any(x[k : k + len(part)] == part for k in range(len(x)))})
                if n < 3:
                    break
                gone.update(range(a, b))
        return " ".join(t for k, t in enumerate(own) if k not in gone or len(gone) == len(own))

    df = spark.createDataFrame([(i, u, make_page(p), "c", "d") for i, u, p in pages], "page_id long, url string, html string, text string, host string")
    got = html_text.main_text(df.repartition(5)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((i, plain(i, u)) for i, u, _ in pages)
    assert any(r["text"] for r in got) and any(r["text"] != " ".join(streams[(r["page_id"], r["url"])]) for r in got)


def test_pages_with_nulls_keep_their_own_text(spark):
    rows = [(1, None, "x"), (1, "x", None), (None, None, None), (None, "http://h/", "<p>y"), (2, "", "")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in got) == sorted([("1", "None", "x"), ("1", "x", ""), ("None", "None", ""), ("None", "http://h/", "y"), ("2", "", "")])
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hash_sample(spark):
    df = spark.range(20_000)
    got = sorted(r["id"] for r in hash_sample(df, 500, "id").collect())
    assert got == sorted(r["id"] for r in df.orderBy(F.xxhash64("id")).limit(500).collect())
    assert hash_sample(df, 30_000, "id").count() == 20_000 and hash_sample(df, 0, "id").count() == 0


def test_string_kernel():
    k = toxicity.kernel_matrix(["idiot", "idxiot", "planet"], ["idiot"])[:, 0]
    assert k[0] == pytest.approx(1) and k[1] > 0.5 > k[2]
    x, _ = toxicity._codes(["abcde", "xaxbx"])
    stem = np.frombuffer("abd".encode("utf-32-le"), np.int32)
    assert toxicity.lcs_lengths(x, stem).tolist() == [3, 2]


def test_classifiers(spark):
    rng = random.Random(9)
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 40).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), bad[i % 3])
        if i % 5 == 0:
            w = [v.upper() + "!!" for v in w]
        rows.append((i, " ".join(w), "a"))
        labels.append((i, int(i % 5 != 0), int(i % 4 == 0)))
    docs = make(spark, [*rows, (1000, None, "a"), (1001, "", None), (1002, "you i d i o t", "a")])
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id < 160"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(240))
    assert got[1002] >= 0.7 and got[1000] == got[1001] < 0.7
    assert toxicity.without_toxic(docs, model).count() == 243 - 61
    got = {r["doc_id"]: r["score"] for r in quality(docs, labels, F.col("doc_id") < 160).collect()}
    assert all((got[i] >= 0.3) == (i % 5 != 0) for i in range(240))
    assert train_rules(np.zeros((0, 13)), np.zeros(0)).rules == []


def plain_levels(calls):
    """(late, level) of each call of one conversation, raised one by one, and the calls of endless ones."""
    value = {c: (t, 0) for c, t, _ in calls}
    needs = {c: [n for n in ns if n in value] for c, _, ns in calls}
    for r in range(3 * len(calls) + 3):
        raised = {c: max([value[c]] + [(value[n][0], value[n][1] + 1) for n in needs[c]]) for c in value}
        if raised == value:
            return value, set()
        value = raised
    # endless: a level that the number of calls cannot give
    return value, {c for c in value if value[c][1] >= len(calls)}


def test_levels_of_random_needs(spark, monkeypatch):
    """Chains, cycles of calls with one need and with several, and what stands behind them."""
    rng = random.Random(12)
    convs = {}
    for c in range(40):
        n = rng.randint(2, 12)
        names = [f"c{i}" for i in range(n)]
        convs[c] = [(x, rng.randint(0, 4), rng.sample(names, rng.choice([0, 1, 1, 1, 2, 3]) if n > 2 else 1)) for x in names]
    calls = [(c, t, x, "search", "{}", ns) for c, rows in convs.items() for x, t, ns in rows]
    calls += [(100, i, f"c{i}", "search", "{}", [f"c{(i + 1) % 1000}"]) for i in range(1000)]  # one cycle
    calls += [(101, 1000 - i, f"c{i}", "search", "{}", [f"c{i - 1}"] if i else []) for i in range(1000)]  # one chain against the turns
    df = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    cuts = []
    real = tool_calls.cut
    monkeypatch.setattr(tool_calls, "cut", lambda d, name="": cuts.append(name) or real(d, name))
    got = {}
    for r in tool_calls.link_tool_calls(df, results, tool_calls.chat_schemas(spark)).collect():
        got.setdefault(r["conv_id"], {})[r["call_id"]] = (r["position"], r["ordered"])
    assert cuts.count("chains") <= 13 and cuts.count("state") <= 15  # rounds
    for c, rows in convs.items():
        value, lost = plain_levels(rows)
        assert {x for x, (_, ok) in got[c].items() if not ok} == lost
        fine = [x for x in value if x not in lost]
        order = sorted(fine, key=lambda x: (value[x], next(t for y, t, _ in rows if y == x), x))
        assert sorted(fine, key=lambda x: got[c][x][0]) == order
    assert not any(ok for _, ok in got[100].values())
    assert [x for x, _ in sorted(got[101].items(), key=lambda e: e[1][0])] == [f"c{i}" for i in range(1000)] and all(ok for _, ok in got[101].values())
