"""Chat formatting with tool-call linking.

Messages carry calls (an identifier, a tool, JSON arguments, identifiers of calls they depend
on) or are the result of a call.

* *Linking*: calls and results are hash-joined on (conversation, identifier).  Of several calls
  or results with one identifier the first by turn counts, the others are ``repeated``;
  a call without result is ``unanswered``, a result without call an ``orphan``.
* *Order*: calls are levelled topologically over all conversations at once (a call's level is one
  above its dependencies' highest): chains by pointer doubling, in rounds that grow with the
  logarithm of their length, then calls with several dependencies in rounds over such calls
  only.  Every round is equi-joins on a table written to the shared folder.  Unknown
  dependencies are errors and wait for nothing; calls on a cycle get no level.
* *Validation*: arguments are parsed as JSON and checked against the tool's schema.
* *Serialisation*: canonical JSON: keys in order, no blanks, null members left out.

Rows are never gathered by conversation, so a conversation of any length is many rows in
many tasks.  Everything runs as DataFrame expressions.

Defined results: one row per message; columns other than these are not read; a null conversation is one conversation; null text is
content null; repeated rows are repeated calls or results; an empty table gives an empty
result."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm.common import documents, shared_table

#: Tool schemas: argument -> (type, required); types as JSON names them.
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "hint": ("string", False)}}
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "object": ("OBJECT<",), "array": ("ARRAY<",),
          "number": ("DECIMAL(", "BIGINT", "DOUBLE", "FLOAT")}
COLUMNS = ("conv_id", "turn", "role", "content", "kind", "call_id", "tool", "arguments", "depends_on")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages: a user turn calls the tool ``reply``,
    an assistant turn is the result of the call one turn before; a call depends on the call
    two turns before it, if its answer is there to build on (turn >= 2)."""
    name = lambda back: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), (F.col("turn") - back).cast("string"))
    call = F.col("role") == "user"
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    return conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(call, name(0)).when(F.col("role") == "assistant", name(1)).alias("call_id"),
        F.when(call, "call").when(F.col("role") == "assistant", "result").otherwise("plain").alias("kind"),
        F.when(call, "reply").alias("tool"), F.when(call, arguments).alias("arguments"),
        F.when(call & (F.col("turn") >= 2), F.array(name(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


def _errors(schemas: dict) -> Column:
    """array<string>: what is wrong with a call's arguments."""
    value = F.try_parse_json("arguments")
    # as text: a type name per member, null where it is missing
    kind = lambda arg: F.schema_of_variant(F.try_variant_get(value, f"$.{arg}", "variant"))
    checks = [
        F.when(value.isNull(), F.lit("arguments: not JSON")),
        F.when(value.isNotNull() & ~F.schema_of_variant(value).startswith("OBJECT<"), F.lit("arguments: not an object")),
        F.when(~F.coalesce(F.col("tool"), F.lit("")).isin(*schemas), F.lit("tool: unknown")),
    ]
    for tool, args in schemas.items():
        own = (F.col("tool") == tool) & value.isNotNull()
        for arg, (kind_name, required) in args.items():
            got = F.coalesce(kind(arg), F.lit("VOID"))
            missing = got == "VOID"
            if required:
                checks.append(F.when(own & missing, F.lit(f"{arg}: missing")))
            checks.append(F.when(own & ~missing & ~reduce(or_, [got.startswith(x) for x in _TYPES[kind_name]]), F.lit(f"{arg}: not {kind_name}")))
        extra = F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in args]))
        checks.append(F.when(own & (F.size(extra) > 0), F.concat(F.array_join(F.array_sort(extra), ","), F.lit(": not in the schema"))))
    return F.array_compact(F.array(*checks))


def levels(calls: DataFrame) -> DataFrame:
    """Calls (scope, call_id, depends_on), one row per identifier -> (scope, call_id, level);
    calls on or behind a cycle are left out.

    Calls with one dependency are chains: pointers are doubled, so a chain of n calls takes
    log n rounds.  A chain ends in a call without dependencies (a root) or with several (a
    join); joins then wait only for the joins their dependencies' chains end in."""
    key = ["scope", "call_id"]
    named = shared_table(calls.select(*key), "chat-calls")
    wants = calls.select(*key, F.explode(F.array_distinct("depends_on")).alias("needs"))
    wants = shared_table(wants.join(named.withColumnRenamed("call_id", "needs"), ["scope", "needs"], "left_semi"), "chat-edges")
    one = wants.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs"))
    # next: where the pointer stands, null once it is at its end; base: the join there, if any
    state = named.join(one, key, "left").select(
        *key, F.when(F.col("n") == 1, F.col("needs")).alias("next"), F.when(F.col("n") > 1, F.col("call_id")).alias("base"),
        F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("steps"))
    state, left = shared_table(state, "chat-chains"), None
    while True:
        now = state.where("next IS NOT NULL").count()
        if now in (0, left):  # none, or only cycles: every round ends some chain that can end
            break
        left = now
        ahead = state.select("scope", F.col("call_id").alias("next"), F.col("next").alias("far"), F.col("base").alias("far_base"), F.col("steps").alias("more"))
        on = state.where("next IS NOT NULL").join(ahead, ["scope", "next"]).select(
            *key, F.col("far").alias("next"), F.col("far_base").alias("base"), (F.col("steps") + F.col("more")).alias("steps"))
        state = shared_table(state.where("next IS NULL").unionByName(on), "chat-chains")
    ends = state.where("next IS NULL").drop("next")
    known = ends.where("base IS NULL").select("scope", F.col("call_id"), F.col("steps").alias("level"))
    joins = ends.where("call_id = base").select(*key)
    if joins.isEmpty():
        return known
    # what each join waits for: (join, how far, steps from there); a dependency on a cycle has no end
    waits = wants.join(joins, key, "left_semi").join(ends.withColumnRenamed("call_id", "needs"), ["scope", "needs"], "left")
    waits = shared_table(waits.select(*key, F.col("steps").isNull().alias("never"), "base", "steps"), "chat-waits")
    done, count = waits.limit(0).select("scope", F.col("call_id").alias("base"), F.lit(0).cast("long").alias("level")), 0
    while True:
        ready = waits.join(done, ["scope", "base"], "left").groupBy(*key).agg(
            F.bool_and(~F.col("never") & (F.col("base").isNull() | F.col("level").isNotNull())).alias("ok"),
            F.max(F.coalesce("level", F.lit(0)) + F.col("steps")).alias("high"))
        done = shared_table(ready.where("ok").select("scope", F.col("call_id").alias("base"), (F.col("high") + 1).alias("level")), "chat-joins")
        if (now := done.count()) == count:
            break
        count = now
    rest = ends.join(done, ["scope", "base"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return known.unionByName(rest)


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """Messages (conv_id, turn, role, content, kind, call_id, tool, arguments, depends_on) with
    status, level, step (place in topological order: by level, a call before its result),
    errors, valid and the canonical ``json``."""
    schemas = SCHEMAS if schemas is None else schemas
    rows = messages.select(*COLUMNS).withColumn("scope", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "chat-messages")
    tied = rows.where("kind <> 'plain' AND call_id IS NOT NULL")
    # the first call and the first result of an identifier; both sides combine per task
    turn = F.struct(F.col("turn").isNull(), "turn", "row")
    first = tied.groupBy("scope", "call_id", "kind").agg(F.min(turn).alias("f")).select("scope", "call_id", "kind", F.col("f.row").alias("row"))
    first = shared_table(first, "chat-first")
    calls = first.where("kind = 'call'").select("scope", "call_id", F.col("row").alias("call_row"))
    results = first.where("kind = 'result'").select("scope", "call_id", F.col("row").alias("result_row"))
    pair = calls.join(results, ["scope", "call_id"], "full_outer")
    # one row per first message: its status and its call's level
    own = tied.where("kind = 'call'").join(calls.select(F.col("call_row").alias("row")), "row", "left_semi")
    level = levels(own.select("scope", "call_id", "depends_on"))
    pair = pair.join(level, ["scope", "call_id"], "left")
    status = F.when(F.col("call_row").isNull(), "orphan").when(F.col("result_row").isNull(), "unanswered").otherwise("linked")
    each = pair.select(F.explode(F.array(F.col("call_row"), F.col("result_row"))).alias("row"), status.alias("s"), "level").where("row IS NOT NULL")
    known = calls.select("scope", F.col("call_id").alias("need"))
    lost = own.select("row", "scope", F.explode(F.array_distinct("depends_on")).alias("need")).join(known, ["scope", "need"], "left_anti")
    lost = lost.groupBy("row").agg(F.sort_array(F.collect_set("need")).alias("lost"))
    out = rows.join(each, "row", "left").join(lost, "row", "left")
    is_call, is_plain = F.col("kind") == "call", F.col("kind") == "plain"
    out = out.withColumn("status", F.when(is_plain, "plain").otherwise(F.coalesce("s", F.lit("repeated"))))
    wrong = F.when(is_call, _errors(schemas)).otherwise(F.array().cast("array<string>"))
    needs = F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("depends_on: unknown "), x))
    loop = F.when(is_call & (F.col("status") != "repeated") & F.col("level").isNull(), F.array(F.lit("depends_on: cycle"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("errors", F.concat(wrong, needs, loop))
    out = out.withColumn("level", F.col("level").cast("long")).withColumn("step", F.col("level") * 2 + F.when(is_call, 0).otherwise(1))
    args = F.try_parse_json("arguments")
    call = F.when(is_call, F.struct(args.alias("arguments"), F.when(F.size("depends_on") > 0, F.col("depends_on")).alias("depends_on"),
                                    F.col("call_id").alias("id"), F.col("tool").alias("name")))
    body = F.struct(call.alias("call"), F.when(~is_call, F.col("content")).alias("content"), F.col("conv_id").alias("conversation"),
                    F.when(F.col("kind") == "result", F.col("call_id")).alias("result_of"), "role", "turn")
    return out.withColumn("valid", F.when(is_call, F.size("errors") == 0)).withColumn("json", F.to_json(body)).select(
        "conv_id", "turn", "role", "kind", "call_id", "status", "level", "step", "valid", "errors", "json")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(from_turns(documents(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "call_id", "status", "level", "step", "valid",
                      F.size("errors").cast("long").alias("n_errors"), "json")


SQL = r"""
WITH RECURSIVE m AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind,
    CASE role WHEN 'user' THEN concat(conv_id, ':', turn) WHEN 'assistant' THEN concat(conv_id, ':', turn - 1) END AS call_id FROM conversations),
l AS (SELECT a.conv_id, a.turn, CAST(0 AS BIGINT) AS level FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn - 2 AND b.kind = 'call'
      WHERE a.kind = 'call' AND b.turn IS NULL
    UNION ALL SELECT a.conv_id, a.turn, l.level + 1 FROM m a JOIN l ON a.conv_id = l.conv_id AND a.turn = l.turn + 2 WHERE a.kind = 'call'),
c AS (SELECT conv_id, call_id, bool_or(kind = 'call') AS called, bool_or(kind = 'result') AS answered FROM m WHERE call_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT m.*, CASE WHEN kind = 'plain' THEN 'plain' WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status, l.level
      FROM m LEFT JOIN c ON c.conv_id = m.conv_id AND c.call_id = m.call_id
      LEFT JOIN l ON l.conv_id = m.conv_id AND l.turn = CASE m.kind WHEN 'call' THEN m.turn WHEN 'result' THEN m.turn - 1 END),
b AS (SELECT r.*, r.kind = 'call' AND r.turn >= 2 AND p.turn IS NULL AS lost FROM r LEFT JOIN m p ON p.conv_id = r.conv_id AND p.turn = r.turn - 2 AND p.kind = 'call')
SELECT conv_id, turn, call_id, status, level, level * 2 + CASE WHEN kind = 'call' THEN 0 ELSE 1 END AS step,
  CASE WHEN kind = 'call' THEN NOT lost END AS valid, CAST(CASE WHEN lost THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
  CASE kind
    WHEN 'call' THEN concat('{"call":{"arguments":{"prompt":', to_json(text), ',"turn":', turn, '},',
      CASE WHEN turn >= 2 THEN concat('"depends_on":["', conv_id, ':', turn - 2, '"],') ELSE '' END, '"id":"', call_id, '","name":"reply"},"conversation":', conv_id)
    WHEN 'result' THEN concat('{"content":', to_json(text), ',"conversation":', conv_id, ',"result_of":"', call_id, '"')
    ELSE concat('{"content":', to_json(text), ',"conversation":', conv_id) END || concat(',"role":"', role, '","turn":', turn, '}') AS json
FROM b
"""
