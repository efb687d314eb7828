"""Vector search, interval joins, stored tables, files and writers against plain versions."""

import random

from pyspark.sql import functions as F

from lapwing.operators import relational, segment, vectors
from lapwing.operators.stored import KeyedTable
from lapwing.sources import ingest


def unit(v):
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def test_vector_search_equals_the_full_scan(spark):
    """Clusters, equal vectors, and a third of all at one place; most comparisons are spared."""
    rng = random.Random(5)
    centres = [unit([rng.gauss(0, 1) for _ in range(16)]) for _ in range(12)]
    rows = [(i, unit([x + rng.gauss(0, 0.03) for x in rng.choice(centres)])) for i in range(600)]
    rows += [(1000 + i, centres[0]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = e.where("vec_id % 20 = 0")
    found, scored = vectors.VectorIndex(e, pivots=25, block=64).search(queries, k=7)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    by = dict(rows)
    dots = {q: {v: sum(x * y for x, y in zip(by[q], w)) for v, w in rows if v != q} for q in by if q % 20 == 0}
    for q, d in dots.items():
        best = sorted(d, key=lambda v: (-round(d[v], 12), v))[:7]
        assert [round(d[v], 9) for _, v in sorted(got[q])] == [round(d[v], 9) for v in best]
    n = scored.agg(F.sum("scored")).first()[0]
    assert n < 0.6 * len(dots) * len(rows)


def plain_attributed(blocks, passages):
    out = {}
    for d, i, text, s, e in blocks:
        p = text.strip().lower()
        for pd, k, ps, pe, ptext in passages:
            q = ptext.strip().lower()
            if pd != d:
                continue
            if ps is not None and pe is not None:
                hit = max(s, ps) < min(e, pe)
            else:
                hit = len(q) >= 15 and (q[:35] in p or p[:35] in q)
            if hit:
                out[(d, i)] = min(k, out.get((d, i), k))
    return out


def test_attributed_blocks(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "a", "of"]
    blocks, passages = [], []
    for d in range(6):
        at = 0
        for i in range(25):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
            blocks.append((d, i, text, at, at + len(text)))
            at += len(text) + 2
        for k in range(20):
            s = rng.randint(0, at)
            placed = rng.random() < 0.5
            src = rng.choice([b for b in blocks if b[0] == d])[2]
            passages.append((d, k, s if placed else None, s + rng.randint(0, 90) if placed else None, rng.choice([src, src[5:], "Alpha beta nothing like it"])))
    b = spark.createDataFrame(blocks, "doc_id long, idx long, text string, start_char long, end_char long")
    p = spark.createDataFrame(passages, "doc_id long, passage long, start_char long, end_char long, text string")
    for few in (0, 400, 10_000):  # all by grams, some, none
        got = {(r["doc_id"], r["idx"]): r["passage"] for r in segment.attributed(b, p, width=16, few=few).collect()}
        assert got == plain_attributed(blocks, passages)


def test_attributed_blocks_of_one_long_document(spark):
    """10^5 blocks and 10^4 passages of one document: the pairs that overlap, not all 10^9."""
    b = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("idx"), F.lit("text of it").alias("text"), (F.col("id") * 50).alias("start_char"), (F.col("id") * 50 + 48).alias("end_char"))
    p = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("passage"), (F.col("id") * 500 + 10).alias("start_char"), (F.col("id") * 500 + 90).alias("end_char"), F.lit("x").alias("text"))
    got = segment.attributed(b, p)
    assert got.count() == 20_000 and got.where("idx div 10 <> passage").count() == 0


def test_stored_table_by_key(spark, tmp_path):
    """Batches against a dictionary; only touched parts get a new version, and a batch that is offered again changes nothing."""
    rng = random.Random(4)
    table = KeyedTable(spark, f"{tmp_path}/t", "k long, v long", ["k"], buckets=8)
    want = {}
    for version in range(4):
        rows = [(rng.randint(0, 30), rng.randint(0, 1000)) for _ in range(40 if version < 3 else 1)]
        for _ in range(2):
            table.upsert(spark.createDataFrame(rows, "k long, v long"), [F.desc("v")], version)
        for k, v in rows:
            want[k] = max(v, want.get(k, -1))
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    parts = spark.read.parquet(f"{tmp_path}/t").where("version = 3").select("bucket").distinct().count()
    assert parts == 1 and table.read().count() == len(want)
    assert KeyedTable(spark, f"{tmp_path}/none", "k long, v long", ["k"]).read().count() == 0


def test_files_of_a_folder(spark, tmp_path):
    files = {"a.txt": b"some text", "deep/b.PDF": b"%PDF", "c.exe": b"x", "d.md": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: (r["size"], r["reason"], r["media_type"]) for r in ingest.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (9, None, "text/plain"), "b.PDF": (4, None, "application/pdf"), "c.exe": (1, "type", "application/octet-stream")}


def test_audit_list_as_csv(spark, tmp_path):
    """Quotes, commas and line ends come back as they were."""
    rows = [("1", 'He said "no", twice', "R,1", "C", "A\nB", 40, "E", "open", 2), ("2", "Ö", None, "C", "A", 0, "E", "open", 0)]
    names = "submission_id string, student_name string, student_roll string, course_code string, assignment string, similarity int, evidence string, review_status string, citation_issues int"
    submissions = spark.createDataFrame(rows, names)
    list_ = relational.audit_rows(submissions)
    relational.write_audit_csv(submissions, f"{tmp_path}/audit")
    back = spark.read.csv(f"{tmp_path}/audit", header=True, multiLine=True, escape='"')
    assert back.columns == list_.columns
    assert sorted(tuple(v or "" for v in r) for r in back.collect()) == sorted(tuple(v or "" for v in r) for r in list_.collect())


def test_embedding_by_a_users_model(spark):
    """Each distinct text is embedded once, in batches of 16 at most; nulls are empty texts."""
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        assert 0 < len(texts) <= 16
        seen.add(len(texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    rows = [(i, ["a", "bab", None, ""][i % 4] if i < 40 else f"text {i}") for i in range(80)]
    got = {r["id"]: r["vector"] for r in vectors.embed_distinct(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", model).collect()}
    assert got == {i: [float(len(t or "")), float((t or "").count("a"))] for i, t in rows}
    assert seen.value == len({t or "" for _, t in rows})
