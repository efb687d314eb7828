"""Tool-call linking for chat data, by DataFrame operations only.

Calls and results are hash-joined by their identifier within a conversation and
put in topological order; a call's arguments are checked against the schema of
its tool and the linked pair is written as canonical JSON: keys in order, no
white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import cut, rank_in_groups

#: Turns in a bucket of a conversation that is ranked in parts.
TURNS = 512


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for every call and every result without a call.

    ``calls``: conv_id long, turn long, call_id string, name string, arguments
    string (JSON object), depends_on array<string>.  ``results``: conv_id, turn,
    call_id, content string.  ``schemas``: name, param, type (a Spark type name
    as JSON has it: STRING, BIGINT, DOUBLE, BOOLEAN), required boolean.

    Returns conv_id, call_id, status (``linked``, ``unanswered``, ``orphan``),
    position (in its conversation's topological order: a call comes after the
    calls that it needs, whatever their turns, and else by turn), ordered (all
    calls that it depends on exist and come before it, which a cycle rules out),
    errors array<string> in order, valid, and json.

    Of calls or results that repeat an identifier in a conversation the first
    counts.  Rows with a null identifier or conversation link to nothing and
    come out as unanswered or orphan.  Arguments that are null or no JSON
    object give the error ``arguments``; a tool without a schema gives
    ``tool``.  Other columns are ignored.
    """
    key = ["conv_id", "call_id"]
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    c = calls.select(*key, "turn", "name", "arguments", "depends_on")
    c = c.where(named).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select(*key, "c.*").union(c.where(~named).select(*key, "turn", "name", "arguments", "depends_on"))
    r = results.select(*key, F.col("turn").alias("result_turn"), "content")
    r = r.where(named).groupBy(*key).agg(F.min(F.struct("result_turn", "content")).alias("r")).select(*key, "r.*").union(r.where(~named))
    both = c.withColumn("is_call", F.lit(True)).join(r.withColumn("is_result", F.lit(True)), key, "full")
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "unanswered").otherwise("linked")
    both = cut(both.withColumn("status", status).withColumn("at", F.coalesce("turn", "result_turn")), "linked_calls")

    # dependencies: each must be a call that comes before
    node = both.where("is_call and call_id is not null and conv_id is not null").select(*key, F.coalesce("at", F.lit(-1)).alias("at"), "depends_on")
    need = node.select(*key, "at", F.explode(F.array_distinct("depends_on")).alias("needs"))
    have = node.select("conv_id", F.col("call_id").alias("needs"), F.col("at").alias("needs_at"))
    edges = cut(need.join(have, ["conv_id", "needs"], "left"), "edges")
    late, cyclic = _levels(node, edges.where("needs_at is not null"))
    lost = edges.where("needs_at is null").select(*key)
    lost = (lost if cyclic is None else lost.union(cyclic)).groupBy(*key).agg(F.count("*").alias("lost"))

    both = both.withColumn("due", F.coalesce("at", F.lit(-1))).withColumn("level", F.lit(0))
    if late is not None:
        both = both.drop("level").join(late, key, "left").withColumn("due", F.coalesce("late", "due")).withColumn("level", F.coalesce("level", F.lit(0)))
        both = cut(both.drop("late"), "levels")
    order = [F.col("due"), F.col("level"), F.col("at").asc_nulls_first(), F.col("call_id").asc_nulls_first(), F.col("status")]
    ranked = rank_in_groups(both, ["conv_id"], order, [], "position", bucket=F.floor(F.col("due") / TURNS))
    rules = schemas.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("param", F.struct(F.upper("type").alias("type"), F.col("required").alias("required")))))).alias("rules"))
    x = ranked.join(rules, "name", "left").join(lost, key, "left")

    value = F.try_parse_json("arguments")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    x = x.withColumn("v", F.when(is_object, value))
    args = F.transform_values(F.expr("cast(v as map<string, variant>)"), lambda k, a: F.schema_of_variant(a))
    x = x.withColumn("types", args)
    missing = F.transform(F.filter(F.map_entries("rules"), lambda e: e["value"]["required"] & ~F.map_contains_key("types", e["key"])), lambda e: F.concat(F.lit("missing "), e["key"]))
    extra = F.transform(F.filter(F.map_keys("types"), lambda k: ~F.map_contains_key("rules", k)), lambda k: F.concat(F.lit("unexpected "), k))
    wrong = F.transform(F.filter(F.map_entries("types"), lambda e: F.coalesce(F.try_element_at("rules", e["key"])["type"] != e["value"], F.lit(False))), lambda e: F.concat(F.lit("type "), e["key"]))
    errors = F.when(F.col("status") == "orphan", F.array(F.lit("call"))).when(F.col("rules").isNull(), F.array(F.lit("tool"))).when(F.col("v").isNull(), F.array(F.lit("arguments")))
    x = x.withColumn("errors", errors.otherwise(F.array_sort(F.concat(missing, extra, wrong))))
    x = x.withColumn("ordered", F.col("lost").isNull())

    def text(column):
        """A string as a JSON string."""
        return F.regexp_extract(F.to_json(F.struct(F.coalesce(column, F.lit("")).alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)

    def field(name, column):
        return F.when(column.isNotNull(), F.concat(F.lit(f'"{name}":'), column))

    fields = [field("arguments", F.to_json("v")), field("id", F.when(F.col("call_id").isNotNull(), text(F.col("call_id")))), field("name", F.when(F.col("name").isNotNull(), text(F.col("name")))), field("result", F.when(F.col("content").isNotNull(), text(F.col("content"))))]
    json = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return x.select("conv_id", "call_id", "status", "position", "ordered", "errors", ((F.size("errors") == 0) & F.col("ordered")).alias("valid"), json.alias("json"))


def _levels(node: DataFrame, edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """``conv_id, call_id, late, level`` of the calls in conversations where the order by turn is not topological, and those that no order suits.

    A call is due at its turn, or at the latest turn at which one that it needs
    is, and then one level above it.  Both are None where every call only needs
    calls of earlier turns.

    Calls that need one other are pointers, which are doubled: chains and simple
    cycles of n calls take log n rounds, and a pointer that never ends has passed a
    cycle.  What is left are calls that need several, of which rounds of joins raise
    those that must be; a call that still moves when there have been more rounds than such
    calls stands behind a cycle.  Levels as high as a conversation has calls tell the lost.
    """
    key = ["conv_id", "call_id"]
    odd = cut(edges.where("needs_at >= at").select("conv_id").distinct(), "odd")
    if not odd.limit(1).count():
        return None, None
    edges = cut(edges.join(odd, "conv_id", "left_semi").select(*key, "needs"), "edges")
    calls = node.join(odd, "conv_id", "left_semi").select(*key, F.col("at").alias("late"))
    most = calls.groupBy("conv_id").agg(F.count("*").alias("most"))
    n = edges.groupBy(*key).agg(F.count("*").alias("n"), F.first("needs").alias("to"))
    calls = cut(calls.join(most, "conv_id").join(n, key, "left").fillna(0, ["n"]).withColumn("level", F.lit(0).cast("long")), "calls")

    value = F.struct("late", "level")
    chain = cut(calls.where("n = 1").select(*key, "late", "level", "to", F.lit(1).cast("long").alias("length"), "most"), "chains")
    while True:
        on = chain.select("conv_id", F.col("call_id").alias("to"), F.col("late").alias("l"), F.col("level").alias("v"), F.col("to").alias("far"), F.col("length").alias("more"))
        x = chain.join(on, ["conv_id", "to"], "left")
        x = x.withColumn("goes", F.col("far").isNotNull() & (F.col("length") < 2 * F.col("most")))
        far = F.struct(F.col("l").alias("late"), (F.col("v") + F.col("length")).alias("level"))
        new = F.when(F.col("goes"), F.greatest(value, far)).otherwise(value)
        x = x.select(*key, new["late"].alias("late"), new["level"].alias("level"), F.when(F.col("goes"), F.col("far")).otherwise(F.col("to")).alias("to"), (F.col("length") + F.when(F.col("goes"), F.col("more")).otherwise(0)).alias("length"), "most", "goes")
        chain = cut(x, "chains")
        if not chain.where("goes").limit(1).count():
            break
        chain = chain.drop("goes")
    endless = F.col("length") >= 2 * F.col("most")
    ends = chain.select("conv_id", F.col("call_id").alias("needs"), F.col("late").alias("l"), F.col("level").alias("v"), F.when(~endless, F.col("to")).alias("far"), F.col("length").alias("more"))

    # calls of several needs: what chains and calls without needs give them at once, and what they wait for
    several = calls.where("n > 1").select(*key, "late", "level", "most")
    need = edges.join(several.select(*key), key, "left_semi").join(ends, ["conv_id", "needs"], "left")
    need = need.withColumn("target", F.when(F.col("more").isNull(), F.col("needs")).otherwise(F.col("far"))).withColumn("length", F.coalesce("more", F.lit(0)) + 1)
    plain = calls.where("n = 0").select("conv_id", F.col("call_id").alias("target"), F.col("late").alias("root"))
    need = cut(need.join(plain, ["conv_id", "target"], "left"), "needs")
    given = need.select(*key, F.explode(F.array(F.struct(F.col("l").alias("late"), (F.col("v") + 1).alias("level")), F.struct(F.col("root").alias("late"), F.col("length").alias("level")))).alias("g")).where("g.late is not null")
    given = given.groupBy(*key).agg(F.max("g").alias("g"))
    best = F.greatest(value, F.col("g"))
    state = several.join(given, key, "left").select(*key, F.coalesce(best["late"], F.col("late")).alias("late"), F.coalesce(best["level"], F.col("level")).alias("level"), "most")
    count = several.groupBy("conv_id").agg(F.count("*").alias("several"))
    state = cut(state.join(count, "conv_id"), "state")
    waits = need.where("root is null and target is not null").select(*key, "target", "length")
    rounds = 0
    while True:
        above = state.select("conv_id", F.col("call_id").alias("target"), F.col("late").alias("l"), F.col("level").alias("v"))
        least = waits.join(above, ["conv_id", "target"]).groupBy(*key).agg(F.max(F.struct(F.col("l").alias("late"), (F.col("v") + F.col("length")).alias("level"))).alias("least"))
        rounds += 1
        moves = F.coalesce(F.col("least") > value, F.lit(False)) & (F.col("level") < 4 * F.col("most"))
        x = state.join(least, key, "left").withColumn("moves", moves)
        # whoever moves after so many rounds does so for ever: far above all others, which they then raise once
        raised = F.when(F.lit(rounds) > F.col("several"), 4 * F.col("most")).otherwise(F.col("least")["level"])
        x = x.select(*key, F.when(F.col("moves"), F.col("least")["late"]).otherwise(F.col("late")).alias("late"), F.when(F.col("moves"), raised).otherwise(F.col("level")).alias("level"), "most", "several", "moves")
        state = cut(x, "state")
        if not state.where("moves").limit(1).count():
            break
        state = state.drop("moves")

    done = state.select(*key, "late", "level", "most").union(calls.where("n = 0").select(*key, "late", "level", "most"))
    far = done.select("conv_id", F.col("call_id").alias("to"), F.col("late").alias("l"), F.col("level").alias("v"))
    x = chain.join(far, ["conv_id", "to"], "left")
    own = F.when(endless | F.col("l").isNull(), value).otherwise(F.greatest(value, F.struct(F.col("l").alias("late"), (F.col("v") + F.col("length")).alias("level"))))
    done = cut(done.union(x.select(*key, own["late"].alias("late"), own["level"].alias("level"), "most")), "levels")
    lost = done.where("level >= most").select(*key)
    return done.select(*key, "late", F.least("level", F.col("most") + 1).cast("int").alias("level")), lost


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off plain chat turns ``conv_id, turn, role, text``.

    A user turn is a call whose tool depends on its number and that needs the
    user turn two before; an assistant turn is the result of the turn before.
    Turns of other roles are neither.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")

    def ident(t):
        return F.concat(F.lit("call_"), conv.cast("string"), F.lit("_"), t.cast("string"))

    name = F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "ask").otherwise("note")
    arguments = F.when(turn % 5 == 4, F.to_json(F.struct(turn.alias("turn")))).otherwise(F.to_json(F.struct(F.col("text").alias("text"), turn.alias("limit"))))
    calls = turns.where("role = 'user'").select(conv.alias("conv_id"), turn.alias("turn"), ident(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.when(turn >= 2, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.where("role = 'assistant'").select(conv.alias("conv_id"), turn.alias("turn"), ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def chat_schemas(spark) -> DataFrame:
    """The tools that :func:`calls_of_turns` calls; ``note`` has no schema."""
    rows = [("search", "text", "STRING", True), ("search", "limit", "BIGINT", False), ("ask", "text", "STRING", True), ("ask", "limit", "BIGINT", True)]
    return spark.createDataFrame(rows, "name string, param string, type string, required boolean")
