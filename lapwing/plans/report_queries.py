"""Queries of the reports and the review workflow, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import relational as r
from lapwing.operators import review
from lapwing.plans.text_queries import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


# Orders stand for submissions: the customer for the student, the day for the assignment.
SUBMISSIONS_SQL = """sub AS (SELECT o_orderkey AS submission_id, o_custkey AS student_id, c_nationkey AS department, n_regionkey AS institution, o_orderkey * 7 % 100 AS similarity,
 CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'analyzed' ELSE 'reviewed' END AS status FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def submissions(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    x = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "needs_review").when(k % 4 == 2, "analyzed").otherwise("reviewed")
    return x.select(k.alias("submission_id"), F.col("o_custkey").alias("student_id"), F.col("c_nationkey").alias("department"), F.col("n_regionkey").alias("institution"), (k * 7 % 100).alias("similarity"), status.alias("status"))


@query("r13_r15_r28_buckets", f"WITH {SUBMISSIONS_SQL} SELECT submission_id, CASE WHEN similarity >= 30 THEN 'danger' WHEN similarity >= 20 THEN 'warning' ELSE 'ok' END AS tone, CASE WHEN similarity >= 40 THEN 'strong' WHEN similarity >= 20 THEN 'moderate' WHEN similarity > 0 THEN 'weak' ELSE 'none' END AS bucket, greatest(0, 10 - similarity // 10)::BIGINT AS marks FROM sub")
def buckets(spark, d):
    s = F.col("similarity")
    return submissions(spark, d).select("submission_id", r.tone(s).alias("tone"), r.evidence_bucket(s).alias("bucket"), r.marks(s).cast("long").alias("marks"))


@query("r16_dashboard", f"WITH {SUBMISSIONS_SQL} SELECT count(*) AS n, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (similarity >= 30) AS high, count(DISTINCT student_id) AS students FROM sub")
def dashboard(spark, d):
    return submissions(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("similarity") >= 30).alias("high"), F.countDistinct("student_id").alias("students"))


@query("r17_attention_items", f"WITH {SUBMISSIONS_SQL}, a AS (SELECT unnest(['high', 'medium', 'pending', 'review']) AS item, unnest([count(*) FILTER (similarity >= 30), count(*) FILTER (similarity >= 20 AND similarity < 30), count(*) FILTER (status = 'pending'), count(*) FILTER (status = 'needs_review')]) AS n FROM sub) SELECT * FROM a WHERE n > 0")
def attention(spark, d):
    return r.attention_items(submissions(spark, d))


@query("r19_rollup", f"WITH {SUBMISSIONS_SQL} SELECT institution, department, count(*) AS n, count(*) FILTER (similarity >= 30) AS high FROM sub GROUP BY ROLLUP (institution, department)")
def rollup(spark, d):
    return r.hierarchy(submissions(spark, d), "institution", "department")


@query("r20_r21_student_summary", f"WITH {SUBMISSIONS_SQL} SELECT student_id, count(*) AS n, floor(avg(similarity) + 0.5)::BIGINT AS mean_similarity, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'needs_review' OR similarity >= 30) AS flagged FROM sub GROUP BY 1")
def student_summary(spark, d):
    return r.summary(submissions(spark, d), "student_id")


@query("r08_not_yet_submitted", "SELECT c_custkey AS student_id, a.i AS assignment_id FROM customer, generate_series(0, 4) AS a(i) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = a.i)")
def not_submitted(spark, d):
    """Assignments of each student without an order that stands for their submission."""
    due = table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("assignment_id"))
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 5).alias("assignment_id"))
    return due.join(done, ["student_id", "assignment_id"], "left_anti")


@query("r10_r37_scope", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2)")
def scope(spark, d):
    taught = table(spark, d, "customer").where("c_nationkey % 5 = 2").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(taught, "o_custkey", "left_semi").select("o_orderkey")


@query("r05_identity_join", """WITH l AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 3 = 1 THEN 'R' || (o_custkey % 900) END AS roll, CASE WHEN o_orderkey % 3 = 2 THEN upper(c_name) END AS name FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT c_custkey AS person_id, 'R' || (c_custkey % 900) AS roll, c_name AS name FROM customer),
e AS (SELECT key, person_id, 1 AS "by" FROM l JOIN p ON l.id = p.person_id UNION ALL SELECT key, person_id, 2 FROM l JOIN p ON l.roll = p.roll UNION ALL SELECT key, person_id, 3 FROM l JOIN p ON lower(l.name) = lower(p.name)),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "by", person_id) AS n FROM e) SELECT key, person_id, "by" FROM n WHERE n = 1""")
def identity(spark, d):
    c, o, k = table(spark, d, "customer"), table(spark, d, "orders"), F.col("o_orderkey")

    def roll(x):
        return F.concat(F.lit("R"), (x % 900).cast("string"))

    left = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("key"), F.when(k % 3 == 0, F.col("o_custkey")).alias("id"), F.when(k % 3 == 1, roll(F.col("o_custkey"))).alias("roll"), F.when(k % 3 == 2, F.upper("c_name")).alias("name"))
    return r.identity_join(left, c.select(F.col("c_custkey").alias("person_id"), roll(F.col("c_custkey")).alias("roll"), F.col("c_name").alias("name")))


@query("io16_r26_top_matches", "SELECT * FROM (SELECT l_orderkey AS submission_id, l_linenumber AS match_id, l_quantity AS similarity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_matches(spark, d):
    return r.top_matches(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("match_id"), F.col("l_quantity").alias("similarity")), 3)


STATES = ("pending", "in_review", "explanation_requested", "explanation_received", "reviewed", "dismissed", "escalated")
EVENTS_SQL = f"ev AS (SELECT user_id AS case_id, event_id, ts, {list(STATES)}[event_id * 5 % 7 + 1] AS state FROM events)"
_LEGAL = str([f"{a}>{b}" for a, bs in review.TRANSITIONS.items() for b in (a, *bs)])


def events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_id", "ts", F.get(F.array(*[F.lit(s) for s in STATES]), (F.col("event_id") * 5 % 7).cast("int")).alias("state"))


@query("e01_e04_audit_trail", f"WITH {EVENTS_SQL}, w AS (SELECT case_id, event_id, state, lag(state) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS previous, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS \"position\" FROM ev) SELECT *, list_contains({_LEGAL}, coalesce(previous, 'pending') || '>' || state) AS legal FROM w")
def audit(spark, d):
    return review.audit_trail(events(spark, d)).drop("ts")


@query("e02_current_state", f"WITH {EVENTS_SQL} SELECT case_id, list_reduce(list_prepend('pending', list(state ORDER BY ts, event_id)), lambda s, x: CASE WHEN list_contains({_LEGAL}, s || '>' || x) THEN x ELSE s END) AS state, count(*) AS n_events FROM ev GROUP BY 1")
def state(spark, d):
    return review.current_state(events(spark, d)).select("case_id", "state", "n_events")


@query("e07_e08_notifications", f"WITH {EVENTS_SQL}, n AS (SELECT case_id, CASE state WHEN 'explanation_requested' THEN 'ask' WHEN 'reviewed' THEN 'decision' END AS type, event_id, state AS title, row_number() OVER (PARTITION BY case_id, state ORDER BY ts DESC, event_id DESC) AS k FROM ev WHERE state IN ('explanation_requested', 'reviewed')) SELECT case_id, type, event_id, title FROM n WHERE k = 1")
def notes(spark, d):
    rules = spark.createDataFrame([("explanation_requested", "ask", "explanation_requested"), ("reviewed", "decision", "reviewed")], "state string, type string, title string")
    return review.notifications(events(spark, d), rules)


@query("e13_turnaround", f"WITH {EVENTS_SQL}, a AS (SELECT case_id, min(ts) AS asked FROM ev WHERE state = 'explanation_requested' GROUP BY 1) SELECT case_id, (floor(epoch(min(ts))) - floor(epoch(asked)))::BIGINT AS seconds FROM ev JOIN a USING (case_id) WHERE state = 'explanation_received' AND ts > asked GROUP BY case_id, asked")
def turnaround(spark, d):
    return review.turnaround(events(spark, d))
