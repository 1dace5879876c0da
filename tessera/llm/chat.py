"""Linking tool calls to their results in chats, with DataFrame functions only.

Calls and results are hash-joined by conversation and call identifier.  Calls are ordered topologically:
a call whose arguments name another call of its conversation ("$ref:<id>") comes after it.  Chains of calls that name
one other each are followed by doubling pointers, so a chain of n calls takes log2(n) rounds of one join; calls that name
several wait, in a round for each step from one such call to the next, until all they name have a depth.  A call on
a cycle, or behind one, never gets a depth and is reported as such.  Arguments are checked against the
tool's schema, and each linked exchange is serialised as canonical JSON (sorted keys, no white space).

Rows stay rows: no conversation is gathered in a task, and the order is given by sortable keys (depth, turn,
call id), so a conversation of any length is fine.

Nulls and ties: messages of a null conversation or turn, and calls or results without an identifier, are
linked to nothing; their status says so.  Of several calls or results with one identifier the one of the smallest
turn counts, then the smallest text; later ones are reported as repeated.  Arguments that aren't a JSON
object are invalid.  Texts of any length are handled whole.  Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A tool's schema: {parameter: (type, required)}; types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"


def extract(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments) of assistant messages and results (conv_id, turn, call_id, content)
    of tool messages whose texts are JSON objects."""
    base = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    base = base.where(F.col("text").rlike(r"^\s*\{"))
    calls = base.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", _CALL).getField("tool_calls")).alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    results = base.where("role = 'tool'").withColumn("r", F.from_json("text", _RESULT))
    return calls, results.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def dialogue(messages: DataFrame, tool: str = "reply", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A plain dialogue in the same form: each user turn calls `tool` with its text and names the exchange before it (two turns
    earlier), and an assistant's message answers the turn before it.  Third are the messages of all other roles."""
    base = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    calls = base.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit(tool).alias("name"),
                                                F.to_json(F.struct(F.when(F.col("turn") > 1, F.concat(F.lit("$ref:"), name(F.col("turn") - 2))).alias("after"), "text", "turn")).alias("arguments"))
    results = base.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, base.where("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", F.col("text").alias("content"))


def _first(rows: DataFrame, then: str) -> DataFrame:
    """Marks, of rows with one identifier, the first; those without one aren't compared."""
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    place = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", F.col(then).asc_nulls_last()))
    known = rows.where(named).withColumn("n", place)
    return known.unionByName(rows.where(~named).withColumn("n", F.lit(0)))


def _type_ok(value: Column, kind: str) -> Column:
    found = F.upper(F.schema_of_variant(value))
    like = {"string": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$",
            "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^OBJECT.*"}[kind]
    return F.coalesce(found.rlike(like), F.lit(False))


def violations(name: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """Array of what is wrong: unknown tools, arguments that are no object, missing, mistyped and unknown parameters."""
    is_object = F.coalesce(F.upper(F.schema_of_variant(parsed)).startswith("OBJECT"), F.lit(False))
    out = F.when(~F.coalesce(name.isin(*schemas) if schemas else F.lit(False), F.lit(False)), F.array(F.lit("unknown tool")))
    out = out.when(~is_object, F.array(F.lit("arguments are no object")))
    keys = F.json_object_keys(arguments)
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            found.append(F.when(missing, F.lit(f"missing {field}") if required else F.lit(None).cast("string")).when(~_type_ok(value, kind), F.lit(f"{field} is no {kind}")))
        other = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>"))), lambda k: F.concat(F.lit("unknown "), k))
        out = out.when(name == tool, F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), F.coalesce(other, F.array().cast("array<string>"))))
    return out.otherwise(F.array().cast("array<string>"))


def _follow(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, dist): how many steps each of the calls that need one other (conv_id, call_id, needs)
    is behind the first call of another kind; without those that lead into a cycle."""
    live = C.materialise(single.select("conv_id", "call_id", F.col("needs").alias("anchor"), F.lit(1).cast("long").alias("dist")))
    longest, reached, every = live.count(), 1, live
    done = live.limit(0)
    while reached <= 2 * longest:
        ahead = every.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("dist").alias("more"))
        moved = C.materialise(live.join(ahead.hint("shuffle_hash"), ["conv_id", "anchor"], "left"))
        done = done.unionByName(moved.where("next IS NULL").select("conv_id", "call_id", "anchor", "dist"))
        live = moved.where("next IS NOT NULL").select("conv_id", "call_id", F.col("next").alias("anchor"), (F.col("dist") + F.col("more")).alias("dist"))
        if live.isEmpty():
            break
        every, reached = done.unionByName(live), 2 * reached
    return done


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of the calls that don't wait for a cycle; calls: conv_id, call_id, arguments, unique."""
    refs = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$ref:([A-Za-z0-9_:.-]+)"), F.lit(1)))).alias("needs"))
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    refs = C.materialise(refs.join(known.hint("shuffle_hash"), ["conv_id", "needs"]))  # others' calls and unknown ones don't bind
    several = refs.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"))
    settled = calls.select("conv_id", "call_id").join(several, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0).cast("long"))
    if refs.isEmpty():
        return settled
    settled = C.materialise(settled)
    counted = refs.join(several, ["conv_id", "call_id"])
    behind = _follow(counted.where("n = 1"))
    steps = behind.select("conv_id", F.col("call_id").alias("needs"), F.col("anchor").alias("far"), "dist")
    waiting = counted.where("n > 1").join(steps, ["conv_id", "needs"], "left")
    waiting = C.materialise(waiting.select("conv_id", "call_id", F.coalesce("far", "needs").alias("anchor"), F.coalesce("dist", F.lit(0)).alias("dist")))
    deep = lambda rows: rows.join(settled.select("conv_id", F.col("call_id").alias("anchor"), "depth").hint("shuffle_hash"), ["conv_id", "anchor"], "left")
    while not waiting.isEmpty():
        reached = deep(waiting).groupBy("conv_id", "call_id").agg(F.max(F.col("depth").isNull()).alias("open"), (F.max(F.col("depth") + F.col("dist")) + 1).alias("depth"))
        freed = C.materialise(reached.where("NOT open").select("conv_id", "call_id", "depth"))
        if freed.isEmpty():
            break
        settled = settled.unionByName(freed)
        waiting = C.materialise(waiting.join(freed, ["conv_id", "call_id"], "left_anti"))
    chained = deep(behind).where("depth IS NOT NULL").select("conv_id", "call_id", (F.col("depth") + F.col("dist")).alias("depth"))
    return C.materialise(settled.unionByName(chained))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, others: DataFrame | None = None) -> DataFrame:
    """One row per call, per result that answers none and per other message: conv_id, call_id, turn, status, depth, valid, problems, json."""
    calls, results = _first(calls, "arguments"), _first(results, "content")
    one, answer = calls.where("n = 1").drop("n"), results.where("n = 1").select("conv_id", "call_id", F.col("turn").alias("r_turn"), "content")
    order = depths(one)
    joined = one.join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer").join(order.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    status = (F.when(F.col("name").isNull() & F.col("turn").isNull(), "orphan result").when(F.col("depth").isNull(), "cycle")
              .when(F.col("r_turn").isNull(), "unanswered").when(F.col("r_turn") < F.col("turn"), "answered before").otherwise("linked"))
    joined = joined.withColumn("status", status).withColumn("at", F.coalesce("turn", "r_turn")).select("conv_id", "call_id", F.col("at").alias("turn"), "name", "arguments", "content", "r_turn", "depth", "status")
    odd_calls = calls.where("n <> 1").select("conv_id", "call_id", "turn", "name", "arguments", F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("r_turn"),
                                             F.lit(None).cast("long").alias("depth"), F.when(F.col("n") == 0, "call without identifier").otherwise("repeated call").alias("status"))
    odd_results = results.where("n <> 1").select("conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content",
                                                 F.col("turn").alias("r_turn"), F.lit(None).cast("long").alias("depth"), F.when(F.col("n") == 0, "result without identifier").otherwise("repeated result").alias("status"))
    rows = joined.unionByName(odd_calls).unionByName(odd_results)
    if others is not None:
        rows = rows.unionByName(others.select("conv_id", "turn", "content", F.lit("message").alias("status")), allowMissingColumns=True)
    parsed = F.try_parse_json("arguments")
    is_call = F.col("arguments").isNotNull() | F.col("name").isNotNull()
    problems = F.when(is_call, violations(F.col("name"), F.col("arguments"), parsed, schemas))
    rows = rows.withColumns({"problems": problems, "valid": F.size(problems) == 0})
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1"))
    canonical = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(parsed), text("arguments")), F.lit(',"call_id":'), text("call_id"), F.lit(',"name":'), text("name"),
                         F.lit(',"result":'), text("content"), F.lit(',"status":'), text("status"), F.lit("}"))
    return rows.select("conv_id", "call_id", "turn", "status", "depth", "valid", "problems", canonical.alias("json"))
