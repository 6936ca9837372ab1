"""Chat formatting with linked tool calls.

Texts may hold ``<tool_call>{"id", "name", "arguments"}</tool_call>`` and ``<tool_result>{"id", "content"}</tool_result>``.
Calls and results become rows of their own and are hash-joined by (conversation, identifier). An argument whose string
value is ``$x`` stands for the result of call x, so that call depends on x.

Order: (order_turn, step, rank, turn, part) is a topological order of a conversation. A message stands at its turn; a
call at the latest of its turn and the places of the results it depends on, a step after them; a result at the later of
its turn and its call's place, in its call's step; within a step messages come first, then calls, then results. Places
are found in rounds, each of which places the calls whose dependencies all have one (as many rounds as the longest
chain of dependencies; none without any). No conversation is gathered into one row or task.

Arguments are checked against ``tools`` (name, argument, type, required), and arguments that the tool does not have are
an error; JSON is written with sorted keys and without spaces. The status of a call is the first that holds of
malformed, duplicate (an id's first call stands), unknown_tool, bad_arguments, bad_reference (it depends on an id without
a call), cyclic, unanswered and ok; of a result malformed, orphan (no call), duplicate (a call's first result stands)
and ok; of a message ok.

Defined results: a null text is an empty message; a null role is written as null; null conversation ids form one
conversation; repeated rows are repeated messages, whose second calls and results are duplicates; what cannot be parsed
is kept as the string ``raw`` of its row; calls that are cyclic stay at their turn; very long texts are formatted whole;
an empty table gives no rows; other columns are not read, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table

#: name, argument, type (JSON kind), required.
TOOLS = (("search", "query", "STRING", True), ("search", "limit", "BIGINT", False), ("calculate", "expression", "STRING", True), ("fetch", "url", "STRING", True))
_CALL, _RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"
_SHAPE = ["conv_id", "turn", "part", "kind", "rank", "order_turn", "step", "call_id", "status", "json"]


def _parts(base: DataFrame, pattern: str, tag: str) -> DataFrame:
    """(conv_id, turn, part, row, json, call_id, name, arguments): every call or result; row tells equal ones apart."""
    some = base.where(F.col("text").contains(tag)).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("part", "raw"))
    v = F.try_parse_json("raw")
    get = lambda p, t: F.try_variant_get(v, p, t)
    json = F.when(v.isNull(), F.to_json(F.struct("raw"))).otherwise(F.to_json(v))
    return some.select(
        "conv_id", "turn", (F.col("part") + 1).alias("part"), F.monotonically_increasing_id().alias("row"), json.alias("json"), get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"), F.to_json(get("$.arguments", "variant")).alias("arguments"),
    )


def _wrong(tools: tuple) -> Column:
    """Whether the arguments (canonical JSON) break the schema of the tool ``name``."""
    arguments = F.try_parse_json("arguments")
    wrong = F.lit(False)
    for tool in sorted({t[0] for t in tools}):
        mine = [t for t in tools if t[0] == tool]
        bad = F.size(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), F.array(*[F.lit(t[1]) for t in mine]))) > 0
        for _, argument, kind, required in mine:
            value = F.try_variant_get(arguments, f"$.{argument}", "variant")
            linked = F.coalesce(F.try_variant_get(arguments, f"$.{argument}", "string").rlike(r"^\$[A-Za-z0-9_-]+$"), F.lit(False))
            other = value.isNotNull() & (F.schema_of_variant(value) != kind) & ~linked
            bad = bad | other | (value.isNull() if required else F.lit(False))
        wrong = wrong | ((F.col("name") == tool) & bad)
    return wrong


def _placed(calls: DataFrame, store: Store) -> DataFrame:
    """(conv_id, call_id, order_turn, step) of first calls whose dependencies can be placed. calls: conv_id, call_id, turn, answered (turn of the result or null), needs."""
    done = F.greatest("order_turn", F.coalesce("answered", "order_turn")).alias("done")
    free = calls.where(F.size("needs") == 0).select("conv_id", "call_id", F.col("turn").alias("order_turn"), F.lit(0).alias("step"), "answered")
    placed, left = store.put(free), store.put(calls.where(F.size("needs") > 0))
    while left.limit(1).count():
        met = left.select("conv_id", F.col("call_id").alias("mine"), F.explode("needs").alias("call_id"))
        p = placed.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), done, "step")
        found = met.join(p, met["conv_id"].eqNullSafe(p["_c"]) & (met["call_id"] == p["_i"])).groupBy("conv_id", "mine").agg(F.count("*").alias("n"), F.max("done").alias("done"), F.max("step").alias("step"))
        found = found.withColumnsRenamed({"conv_id": "_c", "mine": "_i"})
        next_ = left.join(found, left["conv_id"].eqNullSafe(found["_c"]) & (left["call_id"] == found["_i"]) & (F.size("needs") == F.col("n")))
        next_ = store.put(next_.select("conv_id", "call_id", F.greatest("turn", "done").alias("order_turn"), (F.col("step") + 1).alias("step"), "answered"))
        if not next_.limit(1).count():
            break
        placed = store.put(placed.unionByName(next_))
        gone = next_.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"))
        left = store.put(left.join(gone, left["conv_id"].eqNullSafe(gone["_c"]) & (left["call_id"] == gone["_i"]), "left_anti"))
    return placed.select("conv_id", "call_id", "order_turn", "step")


def formatted(chats: DataFrame, store: Store, tools: tuple = TOOLS) -> DataFrame:
    """(conv_id, turn, part, kind, rank, order_turn, step, call_id, status, json) for every message, call and result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = chats.select("conv_id", "turn", "role", text.alias("text"))
    content = F.trim(F.regexp_replace(F.regexp_replace("text", _CALL, ""), _RESULT, ""))
    blank = F.when(F.col("text").contains("<tool_"), content).otherwise(F.col("text"))
    head = F.to_json(F.struct(blank.alias("content")))
    role = F.when(F.col("role").isNull(), F.lit("null")).otherwise(F.expr("substring(to_json(struct(role)), 9, length(to_json(struct(role))) - 9)"))
    messages = base.select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(0).alias("rank"), F.col("turn").alias("order_turn"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"),
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"role":'), role, F.lit("}")).alias("json"),
    )
    if not base.where(F.col("text").contains("<tool_")).limit(1).count():
        return messages.select(*_SHAPE)

    calls, results = store.put(_parts(base, _CALL, "<tool_call>")), store.put(_parts(base, _RESULT, "<tool_result>"))
    named = lambda d: d.where(F.col("call_id").isNotNull())
    first_of = lambda d: named(d).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part", "row")).alias("first"))
    known = F.coalesce(F.col("name").isin(sorted({t[0] for t in tools})), F.lit(False))
    links = F.array_distinct(F.coalesce(F.regexp_extract_all("arguments", F.lit(r'"\$([A-Za-z0-9_-]+)"'), 1), F.array().cast("array<string>")))
    answers = store.put(first_of(results).select("conv_id", "call_id", "first"))
    one = first_of(calls.where(F.col("name").isNotNull()))
    judged = calls.join(one.withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}), calls["conv_id"].eqNullSafe(F.col("_c")) & (calls["call_id"] == F.col("_i")), "left")
    judged = judged.withColumn("stands", F.coalesce(F.col("first.row") == F.col("row"), F.lit(False))).drop("_c", "_i", "first")
    a = answers.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("first.turn").alias("answered"))
    judged = judged.join(a, judged["conv_id"].eqNullSafe(a["_c"]) & (judged["call_id"] == a["_i"]), "left").drop("_c", "_i")
    judged = store.put(judged.withColumns({"needs": links, "wrong": _wrong(tools), "known": known}))
    standing = judged.where("stands")
    ids = standing.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"))
    need = standing.select("conv_id", "call_id", F.explode("needs").alias("need"))
    lost = need.join(ids, need["conv_id"].eqNullSafe(ids["_c"]) & (need["need"] == ids["_i"]), "left_anti").select("conv_id", "call_id").distinct()
    lost = store.put(lost.withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}))
    bound = standing.join(lost, standing["conv_id"].eqNullSafe(lost["_c"]) & (standing["call_id"] == lost["_i"]), "left")
    bound = bound.select("conv_id", "call_id", "turn", "answered", F.when(F.col("_i").isNull(), F.col("needs")).otherwise(F.array().cast("array<string>")).alias("needs"), F.col("_i").isNotNull().alias("lost"))
    bound = store.put(bound)
    places = _placed(bound.drop("lost"), store)
    places = bound.join(places.withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}), bound["conv_id"].eqNullSafe(F.col("_c")) & (bound["call_id"] == F.col("_i")), "left")
    places = store.put(places.select("conv_id", "call_id", "lost", F.col("step").isNull().alias("cyclic"), F.coalesce("order_turn", "turn").alias("at"), F.coalesce("step", F.lit(0)).alias("in_step")).withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}))

    c = judged.join(places, judged["stands"] & judged["conv_id"].eqNullSafe(places["_c"]) & (judged["call_id"] == places["_i"]), "left")
    status = (
        F.when(F.col("call_id").isNull() | F.col("name").isNull(), "malformed").when(~F.col("stands"), "duplicate").when(~F.col("known"), "unknown_tool").when(F.col("wrong"), "bad_arguments")
        .when(F.col("lost"), "bad_reference").when(F.col("cyclic"), "cyclic").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    )
    call_rows = c.select("conv_id", "turn", "part", F.lit("call").alias("kind"), F.lit(1).alias("rank"), F.coalesce("at", "turn").alias("order_turn"), F.coalesce("in_step", F.lit(0)).alias("step"), "call_id", status.alias("status"), "json")
    r = results.join(places, results["conv_id"].eqNullSafe(places["_c"]) & (results["call_id"] == places["_i"]), "left")
    f = answers.select(F.col("conv_id").alias("_a"), F.col("call_id").alias("_b"), F.col("first.row").alias("own"))
    r = r.join(f, r["conv_id"].eqNullSafe(f["_a"]) & (r["call_id"] == f["_b"]), "left")
    verdict = F.when(F.col("call_id").isNull(), "malformed").when(F.col("_i").isNull(), "orphan").when(F.col("own") != F.col("row"), "duplicate").otherwise("ok")
    result_rows = r.select("conv_id", "turn", "part", F.lit("result").alias("kind"), F.lit(2).alias("rank"), F.greatest("turn", F.coalesce("at", "turn")).alias("order_turn"), F.coalesce("in_step", F.lit(0)).alias("step"), "call_id", verdict.alias("status"), "json")
    return messages.select(*_SHAPE).unionByName(call_rows.select(*_SHAPE)).unionByName(result_rows.select(*_SHAPE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), Store(spark, "chat"))


#: Messages; the tables hold no calls, which tests/llm compares with a plain linker on made conversations.
ORACLE_SQL = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS part, 'message' AS kind, CAST(0 AS INTEGER) AS rank, turn AS order_turn, CAST(0 AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""
