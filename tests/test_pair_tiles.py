"""Shingles made in a document's row, and given pairs that are compared in tiles, against SQL."""

import pytest
from pyspark.sql import functions as F

from lapwing.operators import meetings, shingles
from lapwing.plans import registry
from test_oracles import canonical
from test_whole_jobs import both


def plan_of(spark, folder, name):
    return registry.QUERIES[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()


def odd_texts(spark):
    """Boilerplate whole, in parts of words and across words, known terms, repeats, short, empty and null texts, copies."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [
        "on the other hand it is on the other hand it was",
        "xon the other handy n the oth binary search tree all rights reserved",
        "xon the other handy n the oth er hand list of tables binary search tree",
        "a b c d e a b c d e a b c d e",
        "e a b c d e a b c d",
        "one two",
        "",
        None,
        passage,
        passage.upper() + "!",
        *[f"{passage} own{i} last{i % 3} on the other hand p1 p2 p3 p4 p5 p6" for i in range(9)],
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_shingles_of_all_sizes_are_counted_in_the_row(spark, tmp_path):
    got, want = both(spark, tmp_path, "x02_multi_scale", documents=odd_texts(spark))
    assert len(want) > 40 and canonical(got) == canonical(want)
    plan = plan_of(spark, tmp_path, "x02_multi_scale")
    assert "Generate" not in plan and plan.count("Aggregate") == 1  # tokens are dealt out, no shingles
    lists = shingles.token_lists(odd_texts(spark))
    for common in (True, False):  # rows of one id are one document, and sizes of one and two tokens have short shingles
        twice = lists.union(lists.select("doc_id", F.reverse("tokens")))
        old = shingles.multi_scale(twice, (1, 2, 3, 5), common).groupBy("doc_id", "n").agg(F.count("*").alias("n_distinct"), F.sum("pos").alias("places"))
        assert canonical(shingles.multi_counts(twice, (1, 2, 3, 5), common).toPandas()) == canonical(old.toPandas())


def test_drafts_are_compared_in_their_row(spark, tmp_path):
    got, want = both(spark, tmp_path, "a28_drafts", documents=odd_texts(spark).where("text is not null"))
    assert canonical(got) == canonical(want)
    plan = plan_of(spark, tmp_path, "a28_drafts")
    assert not any(x in plan for x in ("Generate", "Join", "Aggregate", "Window"))


@pytest.mark.parametrize("name", ["x04_containment", "x05_single_scale"])
def test_overlaps_are_counted_in_tiles(spark, tmp_path, monkeypatch, name):
    """Over many small tiles, some pairs at a time; a pair is neither joined nor grouped."""
    monkeypatch.setattr(meetings, "PAIRS", 3)
    monkeypatch.setattr(meetings, "AT_A_TIME", 20)
    got, want = both(spark, tmp_path, name, documents=odd_texts(spark).where("text is not null"))
    assert len(want) > 40 and canonical(got) == canonical(want)
    plan = plan_of(spark, tmp_path, name)
    assert "Join" not in plan and plan.count("Aggregate") == 1 and plan.count("MapInArrow") == 1


def test_tiles_of_two_documents(spark):
    lists = shingles.token_lists(odd_texts(spark))
    pairs = lists.select(F.col("doc_id").alias("doc_a")).join(lists.select(F.col("doc_id").alias("doc_b")), F.col("doc_a") != F.col("doc_b"))
    rows = spark.createDataFrame([(i, [i, -i]) for i in range(19)], "doc_id long, v array<long>")

    def compare(table):
        import pyarrow as pa

        v = dict(zip(table.column("doc_id").to_pylist(), table.column("v").to_pylist(), strict=True))
        return lambda a, b: iter([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([v[i][0] - v[k][1] for i, k in zip(a, b, strict=True)])], names=["doc_a", "doc_b", "s"])])

    got = meetings.in_tiles(pairs, rows, compare, "doc_a long, doc_b long, s long", side=2).collect()
    assert sorted(map(tuple, got)) == sorted((i, k, i + k) for i in range(19) for k in range(19) if i != k)


def test_vectors_of_pairs_meet_in_tiles(spark, tmp_path):
    """A document's vector is sent once a tile; texts without content tokens have none, and their pairs score 0."""
    docs = odd_texts(spark).where("text is not null").union(spark.createDataFrame([(50, "a b c d e f"), (51, "b c d e f a b c d e f g")], "doc_id long, text string"))
    got, want = both(spark, tmp_path, "v01_v03_semantic", documents=docs)
    assert len(want) > 40 and 0.0 in set(want["semantic"]) and canonical(got) == canonical(want)
    plan = plan_of(spark, tmp_path, "v01_v03_semantic")
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_runs_of_pairs_are_found_in_tiles(spark, tmp_path, monkeypatch):
    """Runs that repeat on both sides and on several diagonals; no place of a shingle is a row."""
    monkeypatch.setattr(meetings, "AT_A_TIME", 20)
    docs = odd_texts(spark).where("text is not null")
    got, want = both(spark, tmp_path, "x06_x08_verbatim_runs", documents=docs)
    assert len(want) > 60 and canonical(got) == canonical(want)
    plan = plan_of(spark, tmp_path, "x06_x08_verbatim_runs")
    assert not any(x in plan for x in ("Join", "Window", "posexplode"))


def test_sentences_of_pairs_meet_in_tiles(spark, tmp_path, monkeypatch):
    """Ties, repeats and sentences without content tokens; a token of a pair is no row."""
    monkeypatch.setattr(meetings, "AT_A_TIME", 20)
    same = "Harvest moons rise over quiet marble harbours while seven old ferries sleep. It is. Moons moons sleep, harvest harvest. "
    docs = spark.createDataFrame([(i, same * (1 + i % 3) + f"Own{i} ferries sleep over marble. Quiet own{i}.") for i in range(8)] + [(20, "of the and it is in that"), (21, "")], "doc_id long, text string")
    got, want = both(spark, tmp_path, "c02_sentence_candidates", documents=docs)
    assert len(want) > 200 and canonical(got) == canonical(want)
    assert "Join" not in plan_of(spark, tmp_path, "c02_sentence_candidates")


def test_tokens_of_classes_are_made_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "c01_classes", documents=odd_texts(spark).where("text is not null"))
    assert len(want) == 17 and canonical(got) == canonical(want)  # of 19 texts one is null and one empty
    assert "regexp_replace" not in plan_of(spark, tmp_path, "c01_classes")  # the digests are a stage table
