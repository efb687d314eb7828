"""Reports over submissions, students, courses and institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.operators.durable import durable

from lapwing.functions.text import js_round


def tone(similarity: Column) -> Column:
    return F.when(similarity >= 30, "danger").when(similarity >= 20, "warning").otherwise("ok")


def evidence_bucket(similarity: Column) -> Column:
    return F.when(similarity >= 40, "strong").when(similarity >= 20, "moderate").when(similarity > 0, "weak").otherwise("none")


def marks(similarity: Column) -> Column:
    return F.greatest(F.lit(0), 10 - F.floor(similarity / 10))


def optional_filters(df: DataFrame, search: str | None = None, search_in: tuple[str, ...] = (), **equal) -> DataFrame:
    """Equality on each given value (None or ``All ...`` filters nothing) and a case-blind search in some columns."""
    for name, value in equal.items():
        if value is not None and not str(value).startswith("All "):
            df = df.where(F.col(name) == value)
    if search:
        hit = F.lit(False)
        for c in search_in:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(search.lower()))
        df = df.where(hit)
    return df


def identity_join(left: DataFrame, people: DataFrame) -> DataFrame:
    """``left(key, id, roll, name)`` to ``people(person_id, roll, name)`` by id, else roll, else name: three equi-joins, the best one kept.

    Of people with one roll or name only the least id can be kept, so the others are left out before they meet anyone.
    """
    a = left.select("key", "id", F.col("roll").alias("r"), F.lower("name").alias("n"))
    legs = [
        a.join(people.select("person_id"), F.col("id") == F.col("person_id")).select("key", "person_id", F.lit(1).alias("by")),
        a.join(people.groupBy("roll").agg(F.min("person_id").alias("person_id")), F.col("r") == F.col("roll")).select("key", "person_id", F.lit(2).alias("by")),
        a.join(people.groupBy(F.lower("name").alias("pn")).agg(F.min("person_id").alias("person_id")), F.col("n") == F.col("pn")).select("key", "person_id", F.lit(3).alias("by")),
    ]
    every = legs[0].unionByName(legs[1]).unionByName(legs[2])
    return every.groupBy("key").agg(F.min(F.struct("by", "person_id")).alias("m")).select("key", "m.person_id", "m.by")


def summary(submissions: DataFrame, *keys: str) -> DataFrame:
    """Count, rounded mean similarity, pending and flagged by ``keys``."""
    return submissions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        js_round(F.avg("similarity")).alias("mean_similarity"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if((F.col("status") == "needs_review") | (F.col("similarity") >= 30)).alias("flagged"),
    )


def hierarchy(submissions: DataFrame, *levels: str) -> DataFrame:
    """The counts and sums of each level of a hierarchy and of all above it."""
    return submissions.rollup(*levels).agg(F.count("*").alias("n"), F.count_if(F.col("similarity") >= 30).alias("high"))


def attention_items(submissions: DataFrame) -> DataFrame:
    """Counts over a threshold that are not zero: one pass, then a row each."""
    s = F.col("similarity")
    one = submissions.agg(F.count_if(s >= 30).alias("high"), F.count_if((s >= 20) & (s < 30)).alias("medium"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "needs_review").alias("review"))
    return one.selectExpr("stack(4, 'high', high, 'medium', medium, 'pending', pending, 'review', review) as (item, n)").where("n > 0")


def top_matches(matches: DataFrame, k: int = 8) -> DataFrame:
    """Of each submission the ``k`` best matches, as rows."""
    return first_k(matches, "submission_id", [F.desc("similarity"), F.col("match_id")], k)


def latest_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order: a keyed upsert where that puts the latest first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


#: Parts over which rows are dealt for several joins on one key.
PARTS = 128


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` over a fixed number of parts, which the joins on it then share.

    All of them sort in one task a part. Parts of a few packed keys look small, so Spark would put many together if it chose their number.
    """
    return rows.repartition(PARTS, key)


def insert_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return target.unionByName(rows.join(target.select(key), key, "left_anti"))


def replace_children(children: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """The children of every parent in ``rows`` are replaced by those rows."""
    return children.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


# --- predicates, projections, shapes --------------------------------------


def where_all(df: DataFrame, equal: dict | None = None, unequal: dict | None = None, least: dict | None = None, like: dict | None = None, among: dict | None = None, any_of: list[Column] | None = None) -> DataFrame:
    """All given conditions; ``like`` compares patterns whatever the case, ``any_of`` holds alternatives.  Null never fits."""
    for name, v in (equal or {}).items():
        df = df.where(F.col(name) == v)
    for name, v in (unequal or {}).items():
        df = df.where(F.col(name) != v)
    for name, v in (least or {}).items():
        df = df.where(F.col(name) >= v)
    for name, v in (like or {}).items():
        df = df.where(F.col(name).ilike(v))
    for name, v in (among or {}).items():
        df = df.where(F.col(name).isin(*v))
    if any_of:
        hit = any_of[0]
        for c in any_of[1:]:
            hit = hit | c
        df = df.where(hit)
    return df


def project(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns under new names (new: old); a null takes the new name's default."""
    d = defaults or {}
    return df.select(*[(F.coalesce(F.col(old), F.lit(d[new])) if new in d else F.col(old)).alias(new) for new, old in columns.items()])


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows to insert: optional columns that are null or missing take their defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def nested(parent: DataFrame, child: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """Every parent row with its children as a sorted array of structs, empty without any."""
    many = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    x = parent.join(many, key, "left")
    return x.withColumn(name, F.coalesce(name, F.array().cast(many.schema[name].dataType)))


def with_at_least(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with ``n`` rows or more, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def work_of_student(assignments: DataFrame, submissions: DataFrame, student: str = "student_id") -> DataFrame:
    """Every assignment of each student with the student's latest submission, or ``not_submitted``.

    ``assignments``: a row for each assignment and student that has it.
    """
    last = submissions.groupBy("assignment_id", student).agg(F.max_by(F.struct("submission_id", "status"), F.struct("created_at", "submission_id")).alias("s"))
    x = assignments.join(last, ["assignment_id", student], "left")
    return x.select(*assignments.columns, F.col("s.submission_id").alias("submission_id"), F.coalesce("s.status", F.lit("not_submitted")).alias("status"))


def merged_over(preferred: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """All preferred rows, and the defaults whose key they lack."""
    return preferred.unionByName(defaults.join(preferred.select(key), key, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The target's rows and the new ones: of a key the new ones win, of several new ones the first in ``order``."""
    new = latest_by_key(rows, keys, order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_parents(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children of rows that were deleted go with them."""
    return child.join(gone.select(key).distinct(), key, "left_anti")


def recounted(parent: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    """A maintained counter, counted anew."""
    n = child.groupBy(key).agg(F.count("*").alias(name))
    return parent.drop(name).join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def violations(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """``rule, n``: rows that break each check (null breaks none), and rows beyond the first of each unique key."""
    checks = df.agg(*[F.count_if(~c).alias(name) for name, c in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    out = checks.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, n)")
    for name, keys in (unique or {}).items():
        again = df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
        out = out.unionByName(again.select(F.lit(name).alias("rule"), "n"))
    return out


# --- access ---------------------------------------------------------------


def visible_to(viewers: DataFrame, submissions: DataFrame, courses: DataFrame) -> DataFrame:
    """``viewer_id, submission_id`` of every pair that a role allows.

    Admins see all of their institution, faculty the courses they teach, by
    course id or code, students their own work, by id or roll number.
    ``viewers``: viewer_id, role, institution_id, roll.  ``courses``: course_id,
    course_code, faculty_id, institution_id.  Each role is equi-joins of its own.
    """
    v, s = viewers.withColumn("roll", F.lower("roll")), submissions
    taught = v.where("role = 'faculty'").join(courses, F.col("viewer_id") == F.col("faculty_id")).select("viewer_id", F.lower(F.col("course_id").cast("string")).alias("course"), F.lower("course_code").alias("code"))
    own_course = courses.select("course_id", F.col("institution_id").alias("of"))
    parts = [
        v.where("role = 'admin'").join(own_course, F.col("institution_id") == F.col("of")).select("viewer_id", "course_id").join(s.select("submission_id", "course_id"), "course_id"),
        taught.join(s.select("submission_id", F.lower(F.col("course_id").cast("string")).alias("course")), "course"),
        taught.join(s.select("submission_id", F.lower("course_code").alias("code")), "code"),
        v.where("role = 'student'").join(s.select("submission_id", "student_id"), F.col("viewer_id") == F.col("student_id")),
        v.where("role = 'student'").select("viewer_id", "roll").join(s.select("submission_id", F.lower("student_roll").alias("roll")), "roll"),
    ]
    out = parts[0].select("viewer_id", "submission_id")
    for p in parts[1:]:
        out = out.union(p.select("viewer_id", "submission_id"))
    return out.distinct()


def visible_totals(viewers: DataFrame, submissions: DataFrame, courses: DataFrame) -> DataFrame:
    """``viewer_id, n, total``: how many submissions :func:`visible_to` shows to each viewer, and the sum of their ids.

    Admins of the same institutions see the same, which is counted once for all
    of them; no row is made for an admin and a submission.  Viewers of several roles meet their submissions pair by pair.
    """
    figures = (F.count("*").alias("n"), F.sum("submission_id").alias("total"))
    admins = viewers.groupBy("viewer_id").agg(F.bool_and(F.coalesce(F.col("role") == "admin", F.lit(False))).alias("_only"), F.array_sort(F.collect_set("institution_id")).alias("_of"))
    admins = admins.where("_only").select("viewer_id", "_of")
    others = visible_to(viewers.join(admins.select("viewer_id"), "viewer_id", "left_anti"), submissions, courses).groupBy("viewer_id").agg(*figures)
    within = admins.select("_of").distinct().select("_of", F.explode("_of").alias("institution_id")).join(courses.select("institution_id", "course_id"), "institution_id")
    seen = within.select("_of", "course_id").distinct().join(submissions.select("submission_id", "course_id"), "course_id").select("_of", "submission_id").distinct()
    return admins.join(seen.groupBy("_of").agg(*figures), "_of").select("viewer_id", "n", "total").union(others)


#: Fixed texts that stand for what a student may not see.
PROTECTED_PATH, PROTECTED_PEER = "[PROTECTED_STORAGE_URI]", "Peer Student Submission (Protected)"


def masked(submissions: DataFrame, role: Column) -> DataFrame:
    """Submissions as a role may see them: students get no storage path, no faculty notes and no peers' names in ``matches``."""
    student = role == "student"

    def one(m):
        peer = student & (m["source_type"] == "student_submission")
        name = F.when(peer, PROTECTED_PEER).otherwise(m["source_name"])
        return m.withField("source_name", name).withField("source_url", F.when(~F.coalesce(peer, F.lit(False)), m["source_url"]))

    return submissions.withColumns(
        {
            "storage_path": F.when(student, PROTECTED_PATH).otherwise(F.col("storage_path")),
            "faculty_notes": F.when(~student, F.col("faculty_notes")),
            "matches": F.transform("matches", one),
        }
    )


# --- figures --------------------------------------------------------------


def totals(departments: DataFrame, submissions: DataFrame, counters: list[str]) -> DataFrame:
    """Sums of the departments' counters and the real mean similarity, in one row."""
    sums = departments.agg(*[F.sum(c).alias(c) for c in counters])
    return sums.crossJoin(submissions.agg(js_round(F.avg("similarity"), 1).alias("mean_similarity")))  # a row each


def pending_of(courses: DataFrame, submissions: DataFrame, key: str) -> DataFrame:
    """Every course with its submissions and those that still wait."""
    n = submissions.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("pending", "needs_review")).alias("pending"))
    return courses.join(n, key, "left").fillna(0, ["n", "pending"])


def review_counts(submissions: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """One count a review state, in one pass."""
    return submissions.agg(*[F.count_if(F.col("review_status") == s).alias(s) for s in states])


def options(df: DataFrame, *columns: str) -> DataFrame:
    """``column, value``: the distinct values that each column offers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("o")).select("o.*").where("value is not null").distinct()


def rubric_totals(reviews: DataFrame) -> DataFrame:
    """``review_id`` with the points given and possible of ``rubric array<struct<criterion, score, max>>``."""

    def total(field):
        return F.aggregate("rubric", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r[field].cast("long"), F.lit(0).cast("long")))

    return reviews.select("review_id", total("score").alias("score"), total("max").alias("max"))


def shown_submission(submissions: DataFrame) -> DataFrame:
    """Of each student the submission to show: one with feedback or a decision, else a reviewed one, else the first."""
    rank = F.when(F.col("feedback").isNotNull() | F.col("decision").isNotNull(), 0).when(F.col("status") == "reviewed", 1).otherwise(2)
    return submissions.groupBy("student_id").agg(F.min_by(F.struct("submission_id", rank.alias("rank")), F.struct(rank, "created_at", "submission_id")).alias("s")).select("student_id", "s.*")


#: The institution's time zone and forms of dates.
ZONE, DATE, TIME = "Asia/Kolkata", "dd MMM yyyy", "hh:mm a"


def date_and_time(ts: Column, zone: str = ZONE) -> Column:
    """``29 Sep 2026, 10:02 PM`` at the institution; ``N/A`` for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), f"{DATE}, {TIME}"), F.lit("N/A"))


def date_only(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, DATE), F.lit("N/A"))


def time_only(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, TIME), F.lit(""))


def relative_time(ts: Column, now: Column) -> Column:
    """``Just now``, ``5 mins ago``, ``1 hour ago``; a day and more ago the full date; ``Recently`` for null."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    hours = F.floor(minutes / 60)

    def ago(n, unit):
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(ts.isNull(), "Recently").when(minutes < 1, "Just now").when(minutes < 60, ago(minutes, "min")).when(hours < 24, ago(hours, "hour")).otherwise(date_and_time(ts))


def past_due(due: Column, now: Column) -> Column:
    return F.coalesce(due < now, F.lit(False))


def source_distribution(matches: DataFrame) -> DataFrame:
    """The share of each source type in a submission's matched words, in per cent."""
    by = matches.groupBy("submission_id", "source_type").agg(F.sum("matched_words").alias("words"))
    share = F.try_divide(100 * F.col("words"), F.sum("words").over(Window.partitionBy("submission_id")))
    return by.withColumn("share", js_round(share, 1))


def resolve_alias(keys: DataFrame, rows: DataFrame, ident: str) -> DataFrame:
    """``key`` and the row that it names: by id whatever the case, else ``sub-N`` as the N-th row in the order of ids."""
    k = keys.select("key", F.lower("key").alias("k")).distinct()
    by_id = k.join(rows.select(F.lower(F.col(ident).cast("string")).alias("k"), F.col(ident).cast("string").alias("id")), "k").select("key", "id", F.lit(0).alias("by"))
    # the N-th row is the one at some place of one of the ranges that the ids are dealt by
    x = durable(rows.select(F.col(ident).alias("i")).repartitionByRange("i").withColumn("range", F.spark_partition_id()), "ranges")
    size = x.groupBy("range").agg(F.count("*").alias("size"))
    upto = Window.orderBy("range")  # a row a range
    size = size.withColumn("base", F.sum("size").over(upto) - F.col("size"))
    n = k.withColumn("n", F.regexp_extract("k", r"^sub-(\d+)$", 1).try_cast("long")).where("n is not null")
    n = n.join(F.broadcast(size), (F.col("n") > F.col("base")) & (F.col("n") <= F.col("base") + F.col("size"))).select("key", "range", (F.col("n") - F.col("base")).alias("place"))
    nth = x.select("range", F.col("i").cast("string").alias("id"), F.row_number().over(Window.partitionBy("range").orderBy("i")).cast("long").alias("place"))
    by_alias = n.join(nth, ["range", "place"]).select("key", "id", F.lit(1).alias("by"))
    return by_id.union(by_alias).groupBy("key").agg(F.min_by("id", "by").alias("id"))


def audit_rows(submissions: DataFrame) -> DataFrame:
    """The nine columns of the audit list, as text."""
    s = {"ID": "submission_id", "Student": "student_name", "Roll": "student_roll", "Course": "course_code", "Assignment": "assignment", "Evidence": "evidence", "Review Status": "review_status", "Citations": "citation_issues"}
    x = submissions.select(*[F.col(v).cast("string").alias(k) for k, v in s.items()], F.concat(F.col("similarity").cast("string"), F.lit("%")).alias("Similarity"))
    return x.select("ID", "Student", "Roll", "Course", "Assignment", "Similarity", "Evidence", "Review Status", "Citations")


def write_audit_csv(rows: DataFrame, path: str) -> None:
    """Write the list as CSV with a header, every value in quotes and quotes in values doubled, in one ordered set of files."""
    audit_rows(rows).write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def audit_report(submissions: DataFrame, matches: DataFrame, passages: DataFrame, reviews: DataFrame, role: Column, n_matches: int = 8, n_passages: int = 4) -> DataFrame:
    """One row a submission: its best matches and passages, its review, masked for the viewer's role."""
    m = top_matches(matches, n_matches).groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("rank", "match_id", "similarity", "source_type", "source_name", "source_url"))).alias("matches"))
    p = first_k(passages, "submission_id", [F.desc("similarity"), F.col("passage_id")], n_passages)
    p = p.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id", "similarity"))).alias("passages"))
    x = submissions.join(m, "submission_id", "left").join(p, "submission_id", "left").join(reviews, "submission_id", "left")
    x = x.withColumns({"matches": F.coalesce("matches", F.array().cast(m.schema["matches"].dataType)), "passages": F.coalesce("passages", F.array().cast(p.schema["passages"].dataType))})
    return masked(x, role)


def first_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def status_label(status: Column, labels: dict[str, str], otherwise: str) -> Column:
    table = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.coalesce(F.try_element_at(table, status), F.lit(otherwise))


def tagged(c: Column, name: str) -> Column:
    """The value of ``[name: value]`` inside a text, empty if there is none."""
    return F.trim(F.regexp_extract(c, rf"\[{name}:\s*([^\]]+)\]", 1))


def roll_in_parentheses(c: Column) -> Column:
    return F.regexp_extract(c, r"\(([^)]+)\)", 1)
