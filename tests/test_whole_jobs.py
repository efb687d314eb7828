"""Queries on small tables made for one case each, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lapwing.operators import meetings, relational, review, shingles, structure, vectors
from lapwing.plans import registry
from test_oracles import canonical


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over ``tables``, which are written to ``folder``."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return registry.QUERIES[name](spark, str(folder)).toPandas(), con.sql(registry.ORACLES[name]).df()


def test_pseudo_perplexity_takes_the_value_as_it_is(spark, tmp_path):
    """113 / 100 * 100 is less than 113, which decided a tie."""
    events = spark.createDataFrame([(72798, 113.0), (3, 0.5), (7, -0.0)], "event_id long, value double")
    got, want = both(spark, tmp_path, "w10_w12_derived", events=events)
    assert canonical(got) == canonical(want)
    assert got.set_index("event_id")["perplexity"][72798] == 58


def long_texts(spark):
    """Two texts of 100 tokens with a sentence of twelve in common, 8 of 96 shingles, and a short one of its own."""
    same = "Harvest moons rise over quiet marble harbours while seven old ferries sleep."
    own = [" ".join(f"w{k}x{i}" for i in range(44)) + "." for k in range(4)]
    rows = [(1, f"{own[0]} {same} {own[1]}"), (2, f"{own[2]} {same} {own[3]}"), (3, "Nothing here is like them.")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_sentences_of_long_texts_with_a_small_share_meet(spark, tmp_path):
    got, want = both(spark, tmp_path, "c02_sentence_candidates", documents=long_texts(spark))
    assert canonical(got) == canonical(want)
    assert {(r.doc_a, r.doc_b, r.a, r.b) for r in got.itertuples()} == {(1, 2, 1, 1)}


def test_best_sentences_of_long_texts_are_scored(spark, tmp_path):
    got, want = both(spark, tmp_path, "f01_f04_fuzzy", documents=long_texts(spark))
    assert canonical(got) == canonical(want)
    assert [(r.doc_a, r.doc_b, r.span, r.edit) for r in got.itertuples()] == [(1, 2, 1, 100.0)]


def test_peers_of_an_assignment_are_found_all_over_the_table(spark, tmp_path):
    """Assignments have as many peers as there are texts, not 40 neighbours; every assignment has queries."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "'a text that is long enough to be compared ' || id AS text")
    got, want = both(spark, tmp_path, "c06_c12_peers", documents=docs, benchmark=spark.createDataFrame([(7, "x")], "item_id long, text string"))
    assert canonical(got) == canonical(want)
    assert (20, 422) in set(zip(got["doc_id"], got["peer_id"], strict=True))
    assert {d // 20 % 20 for d in got["doc_id"]} == set(range(20))


def test_every_vector_is_compared_with_each_query(spark, tmp_path):
    """All cosines, not the nearest ten; copies, opposite, null and short vectors are there, too."""
    rows = [(i, [float((i * k) % 7 - 3) / 6 for k in range(1, 6)]) for i in range(41)] + [(41, None), (42, [0.5]), (43, [0.5, None, 0.5]), (44, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = both(spark, tmp_path, "v04_dense_cosine", embeddings=e)
    assert canonical(got) == canonical(want)
    assert len(got) == 3 * (len(rows) - 1)
    few = vectors.all_cosines(e.where("vec_id % 20 = 0"), e, of=2, by=7).toDF("a", "b", "semantic").toPandas()
    assert canonical(few) == canonical(want)


def test_totals_of_viewers_are_those_of_the_pairs(spark):
    """Admins of one and of several institutions, of none, and with a second role; no pair is made for an admin alone."""
    v = [(1, "admin", 0, "a"), (2, "admin", 0, "b"), (2, "admin", 1, "b"), (3, "admin", None, "c"), (4, "admin", 1, "d"), (4, "student", 1, "r7"), (5, "faculty", 0, "e"), (6, "student", 0, "R7"), (7, None, 0, "f")]
    viewers = spark.createDataFrame(v, "viewer_id long, role string, institution_id long, roll string")
    courses = spark.createDataFrame([(10, "X", 5, 0), (10, "X", 5, 1), (11, "Y", 6, 1), (12, "x", 5, 2)], "course_id long, course_code string, faculty_id long, institution_id long")
    s = [(i, i % 9, f"r{i % 10}", 10 + i % 3 if i % 4 else None, "x" if i % 5 else None) for i in range(60)]
    submissions = spark.createDataFrame(s, "submission_id long, student_id long, student_roll string, course_id long, course_code string")
    got = relational.visible_totals(viewers, submissions, courses).toPandas()
    pairs = relational.visible_to(viewers, submissions, courses).toPandas()
    want = pairs.groupby("viewer_id")["submission_id"].agg(n="count", total="sum").reset_index()
    assert canonical(got) == canonical(want) and {1, 2, 4, 5, 6} == set(got["viewer_id"])


def test_many_people_of_one_roll_do_not_multiply_rows(spark):
    """A roll and a name of 20,000 people and as many rows: 800 million matches, of which one a row counts."""
    left = spark.range(20000).selectExpr("id AS key", "-1L - id AS id", "'r' AS roll", "'Name' AS name")
    people = spark.range(20000).selectExpr("id + 5 AS person_id", "if(id = 0, null, 'r') AS roll", "'nAme' AS name")
    got = relational.identity_join(left, people)
    assert [tuple(r) for r in got.select("person_id", "by").distinct().collect()] == [(6, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(person_id") == 2  # people are one a roll and one a name before they are joined


def test_notices_of_many_students_of_a_roll_are_not_gathered(spark):
    """A notice found by id and by roll comes once, and what the join gives is not grouped: a task would hold all that a roll's students get."""
    s = [(i, "Z" if i < 20 else str(i % 45)) for i in range(200)] + [(7, "z"), (46, "1"), (300, None), (5, "5"), (None, "9")]
    n = [("z", 1, "a", 5), ("Z", 2, "b", 6), ("7", 1, "a", 7), ("5", 3, "c", 4), ("30", 1, "a", 3), ("30", 1, "a", 3), ("nobody", 1, "a", 1), (None, 2, "a", 1), ("9", 8, "d", 9)]
    students = spark.createDataFrame(s, "student_id long, roll string")
    notes = spark.createDataFrame(n, "student_id string, submission_id long, type string, ts long")
    got = review.inbox(notes, students)
    con = duckdb.connect()
    con.register("s", students.toPandas().astype({"student_id": "Int64"}))
    con.register("n", notes.toPandas())
    want = con.sql("""WITH x AS (SELECT s.student_id, n.student_id AS "to", submission_id, type, ts FROM n JOIN s ON n.student_id = s.student_id::VARCHAR
     UNION SELECT s.student_id, n.student_id, submission_id, type, ts FROM n JOIN s ON lower(n.student_id) = lower(roll))
     SELECT "to", submission_id, type, ts, student_id, row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, submission_id, type) AS rank FROM x""").df()
    whole = {"student_id": "Int64"}
    assert canonical(got.toPandas().astype(whole)) == canonical(want.astype(whole))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rfind("Join") > plan.find("Join") > 0 and "Aggregate" not in plan[: plan.find("Join")]


def test_children_are_dealt_once_over_a_fixed_number_of_parts(spark, tmp_path):
    """Joins on one key follow one another in a task: all their rows are dealt over as many parts, and children are not joined with the same new ones again."""
    tables = {
        "lineitem": spark.createDataFrame([(k,) for k in (1, 1, 2, 4, 4, 8, 9)], "l_orderkey long"),
        "orders": spark.createDataFrame([(k,) for k in (1, 2, 4, 8, 9, 12)], "o_orderkey long"),
        "customer": spark.createDataFrame([(0,), (3,)], "c_custkey long"),
    }
    got, want = both(spark, tmp_path, "io14_io17_children", **tables)
    assert canonical(got) == canonical(want)
    plan = registry.QUERIES["io14_io17_children"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) >= plan.count("Relation [") >= 7 and all(f", {relational.PARTS}" in x for x in dealt)
    assert plan.count("Join") <= 5


def test_style_is_made_in_the_row_of_each_text(spark, tmp_path):
    """Neither sentences nor 3-grams are dealt out; repeats that overlap, odd letters and empty texts count as in the SQL."""
    texts = [
        "",
        " \n ",
        "word",
        "a b c a b c a b c a b c. x y z! x y z? x y z",
        "One two three. One two four. One five.\n\n\nOne two six\n \nİstanbul ΣΑΣ K2 don't stop. Don't stop now! don't stop. 'Tis -- --.",
        "Moreover, MOREOVER. moreovers; furthermore testament serves as a testament. In conclusion: it is worth noting\tthat. delves delve delving",
        "Ha ha ha ha ha ha. Ha ha ha ha. End of it all here. Ha ha so it goes on. Ha ha once more it goes. Well then it ends. Here we are at last",
    ]
    docs = spark.createDataFrame([(5 * i + k, x) for i, x in enumerate(texts) for k in (0, 2)], "doc_id long, text string")
    got, want = both(spark, tmp_path, "w01_w07_style", documents=docs)
    assert canonical(got) == canonical(want)
    plan = registry.QUERIES["w01_w07_style"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and not any(x in plan for x in ("Generate", "Window", "Aggregate", "Join"))


def test_pairs_of_a_frequent_passage_are_no_rows_of_a_shuffle(spark, tmp_path):
    """A passage's shingles of the same documents are one item, whatever its length; pairs equal the SQL over several tiles."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(i % 9 * 40))) for i in range(60)] + [(100, passage), (101, "a b c d e"), (102, "z a b c d e"), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lists = shingles.token_lists(docs)
    items = meetings.shared_items(shingles.distinct_hashes(shingles.representatives(lists), 5)).collect()
    assert {r["doc_id"]: r["weights"] for r in items if r["doc_id"] not in (101, 102)} == {r["doc_id"]: [56] for r in items if r["doc_id"] < 100}
    got, want = both(spark, tmp_path, "c01_candidate_pairs", documents=docs)
    assert len(want) > 1000 and canonical(got) == canonical(want)
    tiled = shingles.candidate_pairs(lists, block=5).toPandas()
    assert canonical(tiled) == canonical(want)


def test_structures_are_compared_once_for_all_pairs_that_have_them(spark, tmp_path, monkeypatch):
    asked = []
    compare = structure._compare
    monkeypatch.setattr(structure, "_compare", lambda pairs, *rest: asked.append(pairs) or compare(pairs, *rest))
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(i * 60, f"{passage} own{i}") for i in range(20)] + [(1, passage), (9, f"Methods\n\n{passage}"), (7, "")], "doc_id long, text string")
    got, want = both(spark, tmp_path, "b01_b02_structure", documents=docs)
    assert len(want) > 200 and canonical(got) == canonical(want)
    assert asked[0].count() <= 9


def test_containment_costs_the_shared_items_of_a_pair(spark, tmp_path):
    """A passage of one size is one item of its documents; containments equal the SQL, common shingles and short texts included."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{passage} own{i} last{i}") for i in range(8)] + [(20, "a b c d e"), (21, "a b c d e f"), (22, "on the other hand it is"), (23, "on the other hand it was")], "doc_id long, text string")
    sets = shingles.distinct_hashes(shingles.token_lists(docs), 4).withColumn("size", F.lit(4))
    items = meetings.shared_items(sets, "size").where("doc_id < 8").collect()
    assert [(r["size"], r["weights"]) for r in items] == [(4, [57])] * 8
    for name in ("x05_single_scale", "x04_containment"):
        got, want = both(spark, tmp_path / name, name, documents=docs)
        assert len(want) >= 28 and canonical(got) == canonical(want)
