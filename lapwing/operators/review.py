"""Review workflow: legal transitions, the current state, and what follows from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.operators.durable import durable

#: The states that may follow each; a state may always repeat.
TRANSITIONS = {
    "pending": ("in_review", "explanation_requested", "reviewed", "dismissed", "escalated"),
    "in_review": ("pending", "explanation_requested", "reviewed", "dismissed", "escalated"),
    "explanation_requested": ("explanation_received", "reviewed", "dismissed", "escalated", "pending"),
    "explanation_received": ("in_review", "reviewed", "explanation_requested", "dismissed", "escalated"),
    "reviewed": ("in_review", "escalated"),
    "dismissed": ("in_review",),
    "escalated": ("in_review", "reviewed", "dismissed"),
}


def is_legal(current: Column, following: Column, role: Column | None = None) -> Column:
    """A student may only send ``explanation_received``; no state before counts as pending."""
    legal = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in (a, *bs)])
    ok = F.array_contains(legal, F.concat(F.coalesce(current, F.lit("pending")), F.lit(">"), following))
    return ok if role is None else ok & ((role != "student") | (following == "explanation_received"))


def audit_trail(events: DataFrame) -> DataFrame:
    """Events ``case_id, event_id, ts, state`` in time order with the state before, their position, and legality."""
    w = Window.partitionBy("case_id").orderBy("ts", "event_id")
    x = events.withColumn("previous", F.lag("state").over(w)).withColumn("position", F.row_number().over(w))
    return x.withColumn("legal", is_legal(F.col("previous"), F.col("state")))


#: Events that are folded in one list.
CHUNK = 4096


def current_state(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The latest *accepted* event of each case: those of steps that the table forbids from the state before leave the state as it is.

    Whether a step is accepted depends on the last accepted one, but what a stretch
    of events does is a map from the few states before it to those after, and such
    maps compose.  Events are sorted by ranges; each ``chunk`` of a case is folded
    from every state at once, and a case's chunks are put together in their order.
    """
    legal = F.create_map(*[F.lit(v) for a, bs in TRANSITIONS.items() for v in (f"{a}", "|".join((a, *bs)))])
    when, none = F.lit(None).cast("timestamp"), F.lit(0).cast("long")

    def step(acc, e):
        ok = F.array_contains(F.split(F.try_element_at(legal, acc["state"]), r"\|"), e["state"])
        new = F.struct(e["state"].alias("state"), e["ts"].cast("timestamp").alias("ts"), (acc["accepted"] + 1).alias("accepted"))
        return F.when(F.coalesce(ok, F.lit(False)), new).otherwise(acc)

    order = ["case_id", "ts", "event_id"]
    x = durable(events.select(*order, "state").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "events")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    x = x.withColumn("part", F.floor(nth / chunk)).groupBy("case_id", "range", "part").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "state"))).alias("e"))
    effects = [F.aggregate("e", F.struct(F.lit(s).alias("state"), when.alias("ts"), none.alias("accepted")), step) for s in TRANSITIONS]
    x = x.select("case_id", "range", "part", F.create_map(*[v for s, f in zip(TRANSITIONS, effects, strict=True) for v in (F.lit(s), f)]).alias("effect"), F.size("e").cast("long").alias("n"))

    def join(acc, c):
        f = F.element_at(c["effect"], acc["state"])
        return F.struct(f["state"].alias("state"), F.coalesce(f["ts"], acc["ts"]).alias("ts"), (acc["accepted"] + f["accepted"]).alias("accepted"))

    x = x.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("range", "part", F.map_entries("effect").alias("effect")))).alias("c"), F.sum("n").alias("n_events"))
    parts = F.transform("c", lambda c: F.struct(F.map_from_entries(c["effect"]).alias("effect")))
    start = F.struct(F.lit("pending").alias("state"), when.alias("ts"), none.alias("accepted"))
    return x.select("case_id", F.aggregate(parts, start, join).alias("s"), "n_events").select("case_id", "s.state", "s.ts", "s.accepted", "n_events")


def notifications(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The newest event of each student and notification type; ``rules(state, type, title)``."""
    x = events.join(F.broadcast(rules), "state")  # a row for each state
    return x.groupBy("case_id", "type").agg(F.max(F.struct("ts", "event_id", "title")).alias("m")).select("case_id", "type", "m.event_id", "m.title")


def turnaround(events: DataFrame) -> DataFrame:
    """Seconds from the first request for an explanation to the first one received after it."""
    asked = events.where("state = 'explanation_requested'").groupBy("case_id").agg(F.min("ts").alias("asked"))
    got = events.where("state = 'explanation_received'").join(asked, "case_id").where("ts > asked").groupBy("case_id", "asked").agg(F.min("ts").alias("got"))
    return got.select("case_id", (F.unix_timestamp("got") - F.unix_timestamp("asked")).alias("seconds"))


#: What faculty may do; students may only send an explanation, admins may do all.
FACULTY_ACTIONS = ("REVIEW_PENDING", "PASSAGE_REVIEWED", "EXPLANATION_REQUESTED", "DECISION_RECORDED", "NOTES_UPDATED", "STATUS_TRANSITION", "RE_ANALYZED")
#: Action, type and title of what a student is told.
NOTICES = (
    ("in_review", "review_started", "Submission Under Review"),
    ("reviewed", "review_completed", "Review Completed"),
    ("PASSAGE_REVIEWED", "system_update", "Passage Concern Noted"),
    ("explanation_requested", "explanation_requested", "Explanation Requested"),
    ("explanation_received", "explanation_received", "Explanation Submitted"),
    ("FEEDBACK_SENT", "faculty_feedback", "Faculty Feedback"),
)


def may_act(role: Column, action: Column) -> Column:
    return F.when(role == "admin", True).when(role == "faculty", action.isin(*FACULTY_ACTIONS)).when(role == "student", action == "EXPLANATION_RECEIVED").otherwise(False)


def submission_status(review_state: Column, status: Column) -> Column:
    """The submission's status that follows from a review state; others leave it."""
    return F.when(review_state == "reviewed", "reviewed").when(review_state == "pending", "needs_review").otherwise(status)


def passage_reviews(rows: DataFrame) -> DataFrame:
    """The latest verdict on each passage of a submission."""
    return rows.groupBy("submission_id", "passage_id").agg(F.max_by(F.struct("verdict", "ts"), F.struct("ts", "event_id")).alias("v")).select("submission_id", "passage_id", "v.*")


def notices(events: DataFrame) -> DataFrame:
    """``student_id, submission_id, type, title, ts, read``: of each student, submission and type the newest event's notice, unread again."""
    rules = F.create_map(*[F.lit(v) for action, kind, title in NOTICES for v in (action, f"{kind}|{title}")])
    x = events.withColumn("_rule", F.try_element_at(rules, F.col("action"))).where("_rule is not null")
    x = x.withColumn("type", F.split_part("_rule", F.lit("|"), F.lit(1))).withColumn("title", F.split_part("_rule", F.lit("|"), F.lit(2)))
    newest = F.max_by(F.struct("title", "ts"), F.struct("ts", "event_id")).alias("n")
    return x.groupBy("student_id", "submission_id", "type").agg(newest).select("student_id", "submission_id", "type", "n.title", "n.ts", F.lit(False).alias("read"))


def with_acks(notes: DataFrame, acks: DataFrame) -> DataFrame:
    """Notices with what was read since: an ack of one type, or of all (null type), as late as the notice."""
    a = acks.groupBy("student_id", "type").agg(F.max("ts").alias("_ack"))
    every = a.where("type is null").select("student_id", F.col("_ack").alias("_all"))
    x = notes.join(a.where("type is not null"), ["student_id", "type"], "left").join(every, "student_id", "left")
    seen = F.coalesce(F.greatest("_ack", "_all") >= F.col("ts"), F.lit(False))
    return x.withColumn("read", F.col("read") | seen).drop("_ack", "_all")


def unread(notes: DataFrame) -> DataFrame:
    return notes.groupBy("student_id").agg(F.count_if(~F.col("read")).alias("unread"), F.count("*").alias("n"))


#: Parts over which the students of one roll are dealt, and those of the tasks that rank; their sizes on disk tell little of their rows, so they are not put together.
ROLL_PARTS, PARTS = 64, 256


def inbox(notes: DataFrame, students: DataFrame) -> DataFrame:
    """Notices of each student, found by id or else by roll number, newest first (``rank``).

    Notices and students are told apart before they meet, and a notice found by id is not taken by roll again, so what they give holds no row twice.
    """
    s = students.select("student_id", F.lower("roll").alias("roll")).distinct()
    named = notes.withColumnRenamed("student_id", "to").distinct()
    own = F.col("to") == F.col("student_id").cast("string")
    by_id = s.select("student_id").distinct().join(named, own).select(*named.columns, "student_id")
    dealt = s.withColumn("_part", F.pmod(F.xxhash64("student_id"), F.lit(ROLL_PARTS)).cast("int")).repartition(PARTS, "roll", "_part")
    called = named.withColumn("roll", F.lower("to")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(ROLL_PARTS - 1)))).repartition(PARTS, "roll", "_part")
    by_roll = dealt.join(called, ["roll", "_part"]).where(~F.coalesce(own, F.lit(False))).select(*named.columns, "student_id")
    every = by_id.union(by_roll).repartition(PARTS, "student_id")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("ts"), "submission_id", "type")))


def reanalysed(analyses: DataFrame, again: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyses with those of ``again`` in place of their old ones, and the audit rows with one for each; reviews are not touched."""
    kept = analyses.join(again.select("submission_id"), "submission_id", "left_anti").unionByName(again)
    rows = again.select("submission_id", F.lit("RE_ANALYZED").alias("action"), F.col("ts"))
    return kept, audit.unionByName(rows)
