"""Streams of files in several batches against the batch operators."""

import random

from pyspark.sql import functions as F

from lapwing.operators import review, shingles
from lapwing.streaming import screening, workflow


def test_arriving_documents_meet_all_earlier_ones(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for i in range(3):
        docs.where(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = screening.screen_stream(stream, f"{tmp_path}/index", f"{tmp_path}/matches", f"{tmp_path}/state")
    q.awaitTermination()
    assert q.exception() is None
    got = {(min(r["doc_id"], r["source_id"]), max(r["doc_id"], r["source_id"]), r["shared"]) for r in screening.read_matches(spark, f"{tmp_path}/matches").collect()}
    s = shingles.shingles(shingles.token_lists(docs), 5).select("doc_id", "shingle").distinct()
    t = s.withColumnRenamed("doc_id", "other")
    n = s.groupBy("doc_id").agg(F.count("*").alias("n"))
    want = s.join(t, "shingle").where("doc_id < other").groupBy("doc_id", "other").count().join(n, "doc_id").join(n.toDF("other", "m"), "other")
    want = want.where(f"count >= {shingles.LEAST_SHARE} * least(n, m)").select("doc_id", "other", "count")
    assert got == {tuple(r) for r in want.collect()} and got
    before = screening.read_matches(spark, f"{tmp_path}/matches").count()
    last = docs.where("doc_id % 3 = 2")  # a batch that is run again writes the same rows
    screening.screen_batch(last, 2, f"{tmp_path}/index", f"{tmp_path}/matches")
    assert screening.read_matches(spark, f"{tmp_path}/matches").count() == before
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    all_ = files(screening.postings(spark, f"{tmp_path}/index", 3, list(range(screening.BUCKETS))))
    assert files(screening.postings(spark, f"{tmp_path}/index", 3, [5, 9])) <= 6 < all_


def test_review_states_of_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    states = F.array(*[F.lit(s) for s in review.TRANSITIONS])
    e = e.select(F.col("user_id").alias("case_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.get(states, (F.col("event_id") * 5 % 7).cast("int")).alias("state"))
    later = F.expr("timestamp '2100-01-01 00:00:00'")
    end = spark.range(1).select(F.lit(-1).cast(e.schema["case_id"].dataType).alias("case_id"), F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), later.alias("ts"), F.lit("reviewed").alias("state"))
    # the events of a case come out of order over three batches; a last one moves the watermark on
    for i, part in enumerate([*(e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)), end]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = workflow.review_states(stream, "400 days").writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("states").where("case_id <> -1").groupBy("case_id").agg(F.max_by("state", F.col("accepted") + F.col("rejected")).alias("state"))
    want = review.current_state(e).select("case_id", "state")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_state_of_a_case_of_many_chunks(spark):
    """Cases folded in chunks of three events against one fold each, ties and unknown states among them."""
    rng = random.Random(6)
    names = [*review.TRANSITIONS, "unknown"]
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randint(0, 40), rng.choice(names)) for i in range(200)]
    e = spark.createDataFrame(rows, "case_id long, event_id long, t long, state string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["case_id"]: (r["state"], r["accepted"], r["n_events"]) for r in review.current_state(e.repartition(3), chunk=3).collect()}
    for case in (1, 2, 3):
        now, accepted, own = "pending", 0, sorted((t, i, s) for c, i, t, s in rows if c == case)
        for _, _, s in own:
            if s == now or s in review.TRANSITIONS[now]:
                now, accepted = s, accepted + 1
        assert got[case] == (now, accepted, len(own))


def test_notices_of_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    actions = F.array(*[F.lit(a) for a, _, _ in review.NOTICES])
    e = e.select("event_id", F.col("user_id").cast("string").alias("student_id"), (F.col("event_id") % 3).alias("submission_id"), F.get(actions, (F.col("event_id") % 6).cast("int")).alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    for i in range(2):
        e.where(F.col("event_id") % 2 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    one = e.where("event_id = 0").withColumn("ts", F.expr("timestamp '2100-01-01 00:00:00'"))
    one.coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    workflow.merge_notices(stream, f"{tmp_path}/notes", f"{tmp_path}/state").awaitTermination()
    key = lambda df: sorted((r["student_id"], r["submission_id"], r["type"], r["title"], r["ts"], r["read"]) for r in df.collect())
    assert key(workflow.read_notices(spark, f"{tmp_path}/notes")) == key(review.notices(e.union(one)))
    versions = spark.read.parquet(f"{tmp_path}/notes").groupBy("version").agg(F.countDistinct("bucket").alias("n")).collect()
    assert {r["version"]: r["n"] for r in versions}[2] == 1  # the last batch rewrote the part of its only student
