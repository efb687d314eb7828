"""Stages of the pipeline against plain versions."""

import random
import re

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def plain_near_dedup(rows):
    """All pairs of rows compared: the groups of rows that links join."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(root(a), []).append(rows[a])
    return groups.values()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for g in range(60):  # one changed word in a text whose shingles number 5 to 60: similarities from 0 to 1, many from 0.80 to 0.85
        w = words(rng, 9 + g)
        out.append((10 * g, " ".join(w)))
        for c in range(3):
            v = list(w)
            for at in rng.sample(range(len(v)), rng.randint(0, 2)):
                v[at] = "changed"
            out.append((10 * g + 1 + c, " ".join(v)))
    w = words(rng, 104)
    out += [(1000 + i, " ".join(w[: 104 - 5 * i])) for i in range(5)]  # 100, 95, ... shingles
    return out


def test_near_copies_from_80_per_cent_go(spark, rows):
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, make(spark, rows), "").collect()}
    assert got == {min(g, key=key) for g in plain_near_dedup(rows)}


def test_near_dedup_judges_rows_apart(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c + " more"), (7, c + " more words"), (7, c + " more words"), (8, None), (8, None), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, make(spark, rows), "").collect()]
    assert sorted(got, key=key) == sorted([(1, a), (2, b), (7, c + " more words"), (8, None), (8, None), (None, "")], key=key)


def test_near_dedup_without_ids(spark):
    text = " ".join(words(random.Random(3), 40))
    got = corpus_pipeline.near_dedup_stage(spark, make(spark, [(None, text), (None, text), (None, text + " more")]), "").collect()
    assert len(got) == 1


def test_decontamination_judges_rows_apart(spark, tmp_path):
    rng = random.Random(4)
    item = words(rng, 14)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [" ".join(words(rng, 30)) for _ in range(6)]
    leak = [" ".join(words(rng, 9) + item[i : i + 10 + i % 2] + words(rng, 5)) for i in range(4)]
    short = " ".join(words(rng, 9) + item[:9])
    rows = [(1, clean[0]), (1, leak[0]), (None, clean[1]), (None, leak[1]), (None, None), (2, leak[2]), (3, short), (3, leak[3]), (4, clean[2]), (4, clean[2])]
    windows = {tuple(item[i : i + 10]) for i in range(5)}
    want = [r for r in rows if not any(tuple(w[i : i + 10]) in windows for w in [(r[1] or "").split()] for i in range(len(w)))]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, make(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) == 6


CLASHING = DOCS + ", _key string, _rk string, _bits string, _part string, key string, row string, rk string, n long"


def test_stages_with_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    """Columns of the helpers' names stay; null ids, sources and texts, empty and very long texts pass; an empty table gives none."""
    rng = random.Random(9)
    spark.createDataFrame([(1, " ".join(words(rng, 12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(words(rng, 40)) for _ in range(6)] + [None, "", " ".join(words(rng, 60_000))]
    rows = [(i if i != 2 else None, t, "en", None if i == 3 else "s", None, "k", "r", "b", "p", "x", "y", "z", i) for i, t in enumerate(texts)]
    rows.append((100, texts[0], *rows[0][2:]))  # a copy
    docs = spark.createDataFrame(rows, CLASHING)
    stages = [corpus_pipeline.near_dedup_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.mixing_stage]
    for stage in stages:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = stage(spark, docs, str(tmp_path))
        assert {tuple(r)[5:12] for r in docs.collect()} == {("k", "r", "b", "p", "x", "y", "z")}
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, None, 3, 4, 5, 8}
    out = corpus_pipeline.token_stage(spark, docs, str(tmp_path)).collect()
    assert len(out) == 7 and sorted(r["start"] for r in out)[0] == 0
    assert corpus_pipeline.token_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_keeps_clean_documents(spark):
    """All stages in a row on the smallest tables: ids that stay are the table's, and copies, leaks and toxic texts are fewer."""
    sf = "/root/testdata/sf0.001"
    before = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and set(ids) < before and len(ids) > len(before) / 2
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
