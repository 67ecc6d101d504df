"""Chat formatting: tool calls linked with their results, ordered, validated and serialised. DataFrame functions only.

Input tables: calls(call_id, after, name, arguments) with arguments as JSON text and `after` the id of the call whose
result the call builds on (null: none), results(call_id, content). Output: one row per call id.

* Linking is a hash join of calls and results by call id; both sides are first reduced to a row per id, so repeated or
  very frequent ids meet as partial aggregates.
* `step` orders the calls topologically: the number of calls that must come before. It is found by pointer doubling:
  each round joins every open call with the call it points to and takes over that call's pointer and distance, so a
  chain of n calls takes log2(n) rounds. Calls on or behind a cycle never close; the rounds end when none closes.
* Arguments are checked against a schema per tool: required and unknown fields, types and ranges.
* `record` is canonical JSON: sorted keys, no white space, nulls left out.

Defined results: calls with a null id are dropped from linking and appear nowhere (an id is what is linked); repeated
ids give one row with the smallest call and the number of copies in `calls`; a missing result gives a null result and
the error `no result`; several results give the smallest and `2 results`; an unknown `after` counts as none, with the
error `unknown predecessor`; arguments that are no JSON object give `arguments are no object`; an unknown tool gives
`unknown tool`; a call on or behind a cycle has a null step and the error `cycle`. Empty tables give empty results.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, read_table

#: Per tool, per field: type (as Spark names it), whether it is required, least and most (length for strings).
Schema = dict[str, dict[str, tuple[str, bool, int | None, int | None]]]
CHAT_SCHEMA: Schema = {
    "ask": {"question": ("string", True, 1, 1000), "turn": ("bigint", True, 0, None), "words": ("bigint", True, 1, 60)},
    "configure": {"prompt": ("string", True, 1, 500), "turn": ("bigint", True, 0, 0)},
}


def _field_errors(parsed: Column, field: str, rule: tuple) -> Column:
    kind, required, least, most = rule
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    type_of = F.regexp_replace(F.schema_of_variant(value), r"^(tinyint|smallint|int)$", "bigint")
    typed = F.try_variant_get(parsed, f"$.{field}", kind)
    size = F.length(typed) if kind == "string" else typed
    checks = F.when(value.isNull(), F.lit(f"{field}: missing") if required else F.lit(None))
    checks = checks.when(F.lower(type_of) != kind, F.lit(f"{field}: not {kind}"))
    if least is not None:
        checks = checks.when(size < least, F.lit(f"{field}: below {least}"))
    if most is not None:
        checks = checks.when(size > most, F.lit(f"{field}: above {most}"))
    return checks


def argument_errors(name: Column, parsed: Column, keys: Column, schema: Schema) -> Column:
    """Errors of parsed arguments against the tool's schema, in order of the fields' names."""
    found = F.when(parsed.isNull() | keys.isNull(), F.array(F.lit("arguments are no object")))
    for tool, fields in sorted(schema.items()):
        errors = F.array(*(_field_errors(parsed, f, r) for f, r in sorted(fields.items())))
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(fields))))), lambda k: F.concat(k, F.lit(": unknown")))
        found = found.when(name == tool, F.concat(F.filter(errors, lambda e: e.isNotNull()), unknown))
    return found.otherwise(F.array(F.lit("unknown tool")))


def steps(calls: DataFrame) -> DataFrame:
    """id, step of calls(id, after); step is null on and behind cycles. Every `after` must be null or a known id."""
    table = materialise(calls.select("id", F.col("after").alias("to"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("step")), "steps")
    open_before = table.where(F.col("to").isNotNull()).count()
    while open_before:
        going = table.where(F.col("to").isNotNull())
        ahead = table.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("step").alias("more"))
        moved = going.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("step") + F.col("more")).alias("step"))
        after = materialise(table.where(F.col("to").isNull()).unionByName(moved), "steps")
        discard(table)
        table, left = after, after.where(F.col("to").isNotNull()).count()
        if left == open_before:
            break
        open_before = left
    return table.select("id", F.when(F.col("to").isNull(), F.col("step")).alias("step"))


def link_calls(calls: DataFrame, results: DataFrame, schema: Schema) -> DataFrame:
    """call_id, calls, results, step, name, valid, errors and record of every call id."""
    call = F.min(F.struct("name", "arguments", "after"))
    calls = calls.where("call_id is not null").groupBy("call_id").agg(call.alias("c"), F.count(F.lit(1)).alias("calls"))
    calls = materialise(calls.select("call_id", "calls", "c.name", "c.arguments", "c.after"), "calls")
    results = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("results"))
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("known"))
    asked = calls.where("after is not null").select("call_id", "after").join(known, "after", "left")
    asked = asked.select("call_id", F.when(F.col("known"), F.col("after")).alias("to"), F.col("known").isNull().alias("lost"))
    ids = calls.select("call_id").join(asked, "call_id", "left")
    ids = materialise(ids.select(F.col("call_id").alias("id"), F.col("to").alias("after"), F.coalesce("lost", F.lit(False)).alias("lost")), "ids")
    order = steps(ids)
    placed = ids.join(order, "id").select(F.col("id").alias("call_id"), "lost", "step")
    rows = calls.join(results, "call_id", "left").join(placed, "call_id")
    parsed = F.try_parse_json("arguments")
    keys = F.json_object_keys("arguments")
    linked = F.array(
        F.when(F.col("results").isNull(), F.lit("no result")),
        F.when(F.col("results") > 1, F.concat(F.col("results").cast("string"), F.lit(" results"))),
        F.when(F.col("calls") > 1, F.concat(F.col("calls").cast("string"), F.lit(" calls"))),
        F.when(F.col("lost"), F.lit("unknown predecessor")),
        F.when(F.col("step").isNull(), F.lit("cycle")),
    )
    errors = F.concat(F.filter(linked, lambda e: e.isNotNull()), argument_errors(F.col("name"), parsed, keys, schema))
    rows = rows.withColumn("errors", errors)
    record = F.to_json(F.struct(F.coalesce(parsed, F.to_variant_object(F.array("arguments"))).alias("arguments"), "call_id", "errors", "name", "result", "step"))
    return rows.select("call_id", "calls", F.coalesce("results", F.lit(0)).cast("long").alias("results"), "step", "name", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), record.alias("record"))


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: an assistant turn is the result of the call made by the turn before it.

    A user turn calls `ask`, a system turn `configure`; a call builds on the nearest earlier one of the conversation.
    """
    ident = lambda back: F.concat_ws("-", F.col("conv_id"), F.col("turn") - back)
    words = F.size(F.split(F.col("text"), " ")).cast("long")
    user = F.col("role") == "user"
    arguments = F.when(user, F.to_json(F.struct(F.col("text").alias("question"), "turn", words.alias("words")))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"), "turn")))
    made = conversations.where("role in ('user', 'system') and conv_id is not null and turn is not null")
    # the turn before is a call itself (a system turn), or else a result, and the call is one further back
    before = conversations.where("role in ('user', 'system')").select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).distinct()
    linked = made.join(before, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    after = F.when(F.col("t").isNotNull(), ident(1)).when(F.col("turn") >= 2, ident(2))
    calls = linked.select(ident(0).alias("call_id"), after.alias("after"), F.when(user, F.lit("ask")).otherwise(F.lit("configure")).alias("name"), arguments.alias("arguments"))
    results = conversations.where("role = 'assistant' and conv_id is not null and turn is not null").select(ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(read_table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, CHAT_SCHEMA)


OP1_SQL = """
WITH RECURSIVE m AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id || '-' || turn AS call_id, conv_id, turn, role, text,
             CASE WHEN turn > 0 AND EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role IN ('user', 'system')) THEN turn - 1
                  WHEN turn >= 2 THEN turn - 2 END AS prior
      FROM m a WHERE role IN ('user', 'system')),
k AS (SELECT c.*, p.turn AS known FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.prior),
s AS (SELECT conv_id, turn, 0::BIGINT AS step FROM k WHERE known IS NULL
      UNION ALL SELECT k.conv_id, k.turn, s.step + 1 FROM k JOIN s ON s.conv_id = k.conv_id AND s.turn = k.known),
r AS (SELECT conv_id, turn - 1 AS turn, text AS result FROM m WHERE role = 'assistant'),
j AS (SELECT k.call_id, k.role, k.text, k.turn, k.prior, k.known, s.step, r.result, len(string_split(k.text, ' ')) AS words, r.turn IS NOT NULL AS has
      FROM k JOIN s ON s.conv_id = k.conv_id AND s.turn = k.turn LEFT JOIN r ON r.conv_id = k.conv_id AND r.turn = k.turn),
e AS (SELECT *, list_filter([CASE WHEN NOT has THEN 'no result' END, CASE WHEN prior IS NOT NULL AND known IS NULL THEN 'unknown predecessor' END,
      CASE WHEN role = 'user' THEN CASE WHEN length(text) < 1 THEN 'question: below 1' WHEN length(text) > 1000 THEN 'question: above 1000' END
           ELSE CASE WHEN length(text) < 1 THEN 'prompt: below 1' WHEN length(text) > 500 THEN 'prompt: above 500' END END,
      CASE WHEN role = 'system' AND turn > 0 THEN 'turn: above 0' END,
      CASE WHEN role = 'user' AND words > 60 THEN 'words: above 60' END], lambda x: x IS NOT NULL) AS errs FROM j)
SELECT call_id, 1::BIGINT AS calls, has::BIGINT AS results, step, CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name, len(errs) = 0 AS valid,
       array_to_string(errs, '; ') AS errors,
       '{"arguments":' || CASE WHEN role = 'user' THEN '{"question":' || to_json(text)::VARCHAR || ',"turn":' || turn || ',"words":' || words || '}' ELSE '{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END
       || ',"call_id":"' || call_id || '","errors":' || to_json(errs)::VARCHAR || ',"name":"' || CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END
       || '"' || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result)::VARCHAR END || ',"step":' || step || '}' AS record
FROM e
"""
