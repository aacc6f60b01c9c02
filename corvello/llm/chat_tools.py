"""Tool calls of conversations: linked with their results, ordered, validated and written as canonical JSON.

An assistant's text that is a JSON object with ``tool_calls`` (a list of {id, name, arguments}) makes calls; the text of
role ``tool`` is a JSON object with ``tool_call_id`` and ``content``; the text of role ``system`` may be a JSON object
with ``tools``, a list of {name, parameters} whose parameters are a JSON schema.

Calls and results meet in a hash join on conversation and identifier, so a conversation that holds a third of all rows
is spread over many tasks.  A call depends on the calls whose ids its arguments name as ``${id}``; its level is one more
than that of the deepest of them, found by peeling off calls without open dependencies, a written table each round.
A message's calls are written by (level, place), those without level last, beside its content and other keys.
Arguments are compared with the schema of the tool of that name in the conversation, a written table for each level of
nesting: type (also a list), enum, const, bounds of numbers, lengths and counts, required, properties,
additionalProperties and items.  Canonical JSON has sorted keys and
no blanks.  No row is collected by conversation: a message's place is its (turn, level).

Defined results: texts that are no such JSON, null texts and null roles are plain content; a null content is left out;
a call without id or name is invalid and unlinked; of several results with one id the one of the least turn (then least
content) is linked; calls on a cycle have no level; without a schema a call's arguments need only be an object;
rows that repeat are formatted each, and the calls of an id that a conversation repeats share level and result; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvello.llm.common import discard, materialise

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_TOOLS = "struct<tools:array<struct<name:string,parameters:variant>>>"

# The types of a JSON schema and the patterns of the variant types that satisfy them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*", "null": "VOID"}


def _object(text: Column) -> Column:
    return text.rlike(r"^\s*\{")


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks, or null; variants keep an object's keys in order."""
    return F.to_json(F.try_parse_json(json))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with key (each row has its own), calls, result and tools."""
    rows = messages.select("conv_id", "turn", "role", "text")
    role = lambda r: (F.col("role") == r) & _object(F.col("text"))
    return rows.select(
        "*", F.monotonically_increasing_id().alias("key"),
        F.when(role("assistant"), F.from_json("text", _CALLS)["tool_calls"]).alias("calls"),
        F.when(role("tool"), F.from_json("text", _RESULT)).alias("result"),
        F.when(role("system"), F.from_json("text", _TOOLS)["tools"]).alias("tools"),
    )


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the calls that are on no cycle and depend on none that is."""
    needs = calls.select("conv_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$\{([^}]+)\}"), F.lit(1)))).alias("need"))
    known = calls.select("conv_id", "id").distinct()
    left = materialise(needs.join(known.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_semi").distinct(), "call-needs")
    done, rest, level = [], materialise(known, "calls"), 0
    while True:
        ready = rest.join(left, ["conv_id", "id"], "left_anti")
        done.append(ready.withColumn("level", F.lit(level)))
        if not left.limit(1).count():
            break
        after = materialise(left.join(ready.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_anti"), "call-needs")
        rest = materialise(rest.join(left, ["conv_id", "id"], "left_semi"), "calls")
        if after.count() == left.count():
            break
        left, level = after, level + 1  # earlier tables are read again below
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return materialise(out, "call-levels")


def _violated(v: Column, s: Column) -> Column:
    """Whether a value breaks a keyword of its schema that concerns the value itself; both are variants."""
    kind, at = F.schema_of_variant(v), lambda path, to: F.try_variant_get(s, "$." + path, to)
    listed = F.coalesce(F.when(F.schema_of_variant(at("type", "variant")).startswith("ARRAY"), at("type", "array<string>")), F.array(at("type", "string")))
    pattern = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    number = F.when(kind.rlike("^" + TYPES["number"] + "$"), F.try_variant_get(v, "$", "double"))
    whole = lambda t: (t == "integer") & F.coalesce(number == F.floor(number), F.lit(False))
    fits = F.exists(listed, lambda t: F.coalesce(F.rlike(kind, F.concat(F.lit("^"), F.try_element_at(pattern, t), F.lit("$"))), F.lit(True)) | whole(t))
    same = lambda x: F.to_json(x) == F.to_json(v)
    length = F.when(kind == "STRING", F.length(F.try_variant_get(v, "$", "string")))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    keys = F.when(kind.startswith("OBJECT"), F.json_object_keys(F.to_json(v)))
    bound = lambda path: at(path, "double")
    strict = lambda path: F.coalesce(F.schema_of_variant(at(path, "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(at(path, "boolean"), F.lit(False))
    over = lambda path: F.when(F.schema_of_variant(at(path, "variant")) != "BOOLEAN", bound(path))
    broken = [
        (F.schema_of_variant(s) == "BOOLEAN") & ~F.try_variant_get(s, "$", "boolean"), ~fits,
        ~F.exists(at("enum", "array<variant>"), same), ~same(at("const", "variant")),
        number < bound("minimum"), number > bound("maximum"), number <= over("exclusiveMinimum"), number >= over("exclusiveMaximum"),
        strict("exclusiveMinimum") & (number == bound("minimum")), strict("exclusiveMaximum") & (number == bound("maximum")),
        length < bound("minLength"), length > bound("maxLength"), F.size(items) < bound("minItems"), F.size(items) > bound("maxItems"),
        F.size(keys) < bound("minProperties"), F.size(keys) > bound("maxProperties"), F.size(F.array_except(at("required", "array<string>"), keys)) > 0,
    ]
    out = F.lit(False)
    for b in broken:
        out = out | F.coalesce(b, F.lit(False))
    return out


def violations(values: DataFrame) -> DataFrame:
    """(key, pos) of calls of which a value breaks its schema; values: key, pos, value and schema as JSON texts."""
    bad, level = [], materialise(values, "schema-values")
    while level.limit(1).count():
        v, s = F.try_parse_json("value"), F.try_parse_json("schema")
        bad.append(level.where(_violated(v, s)).select("key", "pos"))
        part = lambda path: F.to_json(F.try_variant_get(s, "$." + path, "variant"))  # noqa: B023, E731
        fields = level.where(F.schema_of_variant(v).startswith("OBJECT")).select("key", "pos", F.from_json(part("properties"), "map<string,variant>").alias("p"), part("additionalProperties").alias("more"), F.explode(F.from_json("value", "map<string,variant>")).alias("field", "v"))
        fields = fields.select("key", "pos", F.to_json("v").alias("value"), F.coalesce(F.to_json(F.try_element_at("p", F.col("field"))), F.col("more")).alias("schema"))
        items = level.where(F.schema_of_variant(v).startswith("ARRAY")).select("key", "pos", part("items").alias("schema"), F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("v"))
        level = materialise(fields.union(items.select("key", "pos", F.to_json("v").alias("value"), "schema")).where("schema IS NOT NULL"), "schema-values")
    out = values.select("key", "pos").limit(0)
    for more in bad:
        out = out.union(more)
    return out.distinct()


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (conv_id, id, name, arguments, ...) with valid; tools: conv_id, name and the schema's JSON."""
    ids = calls.columns
    value = F.try_parse_json("arguments")
    bad = violations(calls.join(tools.hint("merge"), ["conv_id", "name"]).select("key", "pos", F.to_json(value).alias("value"), "schema").where("value IS NOT NULL AND schema IS NOT NULL")).withColumn("bad", F.lit(True))
    sound = F.col("id").isNotNull() & F.col("name").isNotNull() & F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return calls.join(bad, ["key", "pos"], "left").select(*ids, (sound & F.col("bad").isNull()).alias("valid"))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_valid, level (deepest call's; null without calls or on a cycle) and message."""
    rows = materialise(parsed(messages), "messages")  # so that each row keeps its key
    call = F.posexplode("calls").alias("pos", "c")
    calls = rows.where("calls IS NOT NULL").select("conv_id", "key", call).select("conv_id", "key", "pos", "c.*")
    results = rows.where("result.tool_call_id IS NOT NULL").groupBy("conv_id", F.col("result.tool_call_id").alias("id")).agg(F.min(F.struct("turn", "result.content")).alias("r"))
    tools = rows.where("tools IS NOT NULL").select("conv_id", F.explode("tools").alias("t")).select("conv_id", "t.name", F.to_json("t.parameters").alias("schema"))
    # One row for each identifier or name, written: a conversation's many calls of one are then a join that can be split.
    results = materialise(results.select("conv_id", "id", "r.content", F.lit(True).alias("linked")), "results")
    tools = materialise(tools.groupBy("conv_id", "name").agg(F.min("schema").alias("schema")), "tools")
    linked = validated(calls, tools).join(results.hint("merge"), ["conv_id", "id"], "left")
    levels = call_levels(calls.where("id IS NOT NULL"))
    linked = linked.join(levels.hint("merge"), ["conv_id", "id"], "left")
    # A message has few calls: this groups by message, not by conversation.
    one = F.struct(F.col("level").isNull().alias("last"), F.col("level").alias("order"), "pos", F.struct(F.coalesce(canonical(F.col("arguments")), F.col("arguments")).alias("arguments"), "id", "level", "name", F.col("content").alias("result"), "valid").alias("c"))
    by_message = linked.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count("linked").alias("n_linked"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"),
        F.when(F.count("level") == F.count(F.lit(1)), F.max("level")).alias("level"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("calls"),
    )
    named = materialise(calls.where("id IS NOT NULL").groupBy("conv_id", F.col("id").alias("call_id")).agg(F.min("name").alias("call_name")), "names")

    def shown(frame: DataFrame, message: Column, **more: Column) -> DataFrame:
        n = lambda c: more.get(c, F.lit(0)).cast("long").alias(c)
        return frame.select("conv_id", "turn", "role", n("n_calls"), n("n_linked"), n("n_valid"), more.get("level", F.lit(None)).cast("int").alias("level"), message.alias("message"))

    plain = shown(rows.where("calls IS NULL AND result IS NULL"), F.to_json(F.struct(F.col("text").alias("content"), "role")))
    back = rows.where("result IS NOT NULL").withColumn("call_id", F.col("result.tool_call_id")).join(named.hint("merge"), ["conv_id", "call_id"], "left")
    back = shown(back, F.to_json(F.struct(F.col("result.content").alias("content"), F.col("call_name").alias("name"), "role", F.col("call_id").alias("tool_call_id"))), n_linked=F.when(F.col("call_name").isNotNull(), 1).otherwise(0))
    made = rows.where("calls IS NOT NULL").drop("calls").join(by_message, "key", "left")
    message = F.to_json(F.struct("role", F.coalesce("calls", F.expr("array()").cast(by_message.schema["calls"].dataType)).alias("tool_calls")))
    # The text's other keys; a null content is left out.
    rest = F.to_json(F.map_filter(F.from_json("text", "map<string,variant>"), lambda k, v: ~k.isin("role", "tool_calls") & ~((k == "content") & F.is_variant_null(v))))
    both = canonical(F.concat(F.expr("substring(rest, 1, length(rest) - 1)"), F.lit(","), F.expr("substring(message, 2)")))
    made = made.withColumn("rest", rest).withColumn("message", message)
    made = shown(made, F.when(F.col("rest") != "{}", F.coalesce(both, "message")).otherwise(F.col("message")), **{c: F.coalesce(c, F.lit(0)) for c in ("n_calls", "n_linked", "n_valid")}, level=F.col("level"))
    out = materialise(plain.union(back).union(made), "formatted")
    discard(rows, results, tools, levels, named)
    return out
