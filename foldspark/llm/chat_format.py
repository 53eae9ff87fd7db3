"""Chat formatting with tool-call linking. DataFrame functions only.

An assistant's text may be a JSON object with `tool_calls`, a list of {id, name, arguments, after}; a tool's text may be
one with `tool_call_id` and `content`. Calls and results are joined on (conversation, identifier), calls are levelled by
the calls that they come `after`, arguments are validated against the tool's schema, and each message is written as
canonical JSON: members in code-point order, no white space. Messages stay rows of their own with a sortable place, so no
conversation, however long, is ever gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.chat_calls import json_string
from foldspark.llm.common import materialise

#: Arguments of the known tools: name -> (type, required). Types are those of `_is`.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "timeout": ("number", False)},
    "python": {"code": ("string", True)},
}
#: place_level of messages whose calls are in or after a cycle.
NO_LEVEL = (1 << 31) - 1

_CALL = "array<struct<id: string, name: string, arguments: variant, after: array<string>>>"


def _is(value: Column, kind: str) -> Column:
    """Is the variant of this kind of JSON value?"""
    found = F.schema_of_variant(value)
    return {"string": found == "STRING", "boolean": found == "BOOLEAN", "integer": found == "BIGINT", "number": (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL"), "object": found.startswith("OBJECT"), "array": found.startswith("ARRAY")}[kind]


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted array of what is wrong with a call's arguments; an unknown tool is an error itself."""
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        found = []
        for arg, (kind, required) in sorted(schema.items()):
            value = F.try_variant_get(arguments, f"$['{arg}']", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            found.append(F.when(missing, F.lit(f"{arg}: missing") if required else F.lit(None).cast("string")).when(~_is(value, kind), F.lit(f"{arg}: not a {kind}")))
        odd = F.array_except(F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(schema))))
        extra = F.transform(F.array_sort(odd), lambda k: F.concat(k, F.lit(": unknown")))
        broken = F.when(arguments.isNull() | ~F.coalesce(_is(arguments, "object"), F.lit(False)), F.array(F.lit("arguments: not an object")))
        out = F.when(name == tool, F.coalesce(broken, F.concat(F.array_compact(F.array(*found)), extra))).otherwise(out)
    return out


def _jumped(one: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, steps) of calls that come after one call each: the first call up the chain that does not.

    Each round doubles how far a call has looked, so a chain of n calls takes log2(n) rounds. A call on a cycle of such
    calls, or behind one, has no root and no row.
    """
    key = ["conv_id", "call_id"]
    far = materialise(one.select(*key, F.col("before").alias("root"), F.lit(1).alias("steps")), "call-chains")
    waiting = -1
    while True:
        on = far.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        joined = far.join(on, ["conv_id", "root"], "left")
        count = joined.where("more is not null").count()
        if count in (0, waiting):
            return joined.where("more is null").select(*key, "root", "steps")
        waiting = count
        far = materialise(joined.select(*key, F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "call-chains")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without known predecessors, else one above the highest; calls in or after a cycle
    have no row. Chains are jumped over; what is left takes a join for each call with several predecessors on a path."""
    key = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    need = materialise(calls.select(*key, F.explode(F.array_distinct("after")).alias("before")).join(known, ["conv_id", "before"]), "call-order")
    degree = need.groupBy(*key).count()
    one = need.join(degree.where("count = 1").drop("count"), key, "left_semi")
    chains = materialise(_jumped(one), "call-chains")
    # a predecessor that is in a chain stands for the chain's root and its place in it; one on a cycle for nothing that comes
    of = chains.withColumnRenamed("call_id", "before").select("conv_id", "before", F.col("root"), "steps")
    single = one.select("conv_id", F.col("call_id").alias("before"), F.lit(True).alias("chained"))
    several = need.join(degree.where("count > 1").drop("count"), key, "left_semi").join(of, ["conv_id", "before"], "left").join(single, ["conv_id", "before"], "left")
    several = several.select(*key, F.when(F.col("root").isNotNull(), F.col("root")).when(F.col("chained").isNull(), F.col("before")).alias("root"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    several = materialise(several, "call-order")
    found = materialise(calls.select(*key).join(degree, key, "left_anti").withColumn("level", F.lit(0)), "call-levels")
    while True:
        open_ = several.join(found.select(*key), key, "left_anti")
        at = open_.join(found.withColumnRenamed("call_id", "root"), ["conv_id", "root"], "left")
        new = at.groupBy(*key).agg(F.count("*").alias("all"), F.count("level").alias("known"), F.max(F.col("level") + F.col("steps")).alias("level")).where("all = known").select(*key, "level")
        new = materialise(new, "call-levels")
        if new.isEmpty():
            break
        found = materialise(found.union(new), "call-levels")
    behind = chains.join(found.withColumnRenamed("call_id", "root"), ["conv_id", "root"])
    return found.union(behind.select(*key, (F.col("level") + F.col("steps")).alias("level")))


def format_chats(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row for each message: (conv_id, turn, place_turn, place_level, place_kind, role, calls, linked, errors, message).

    Sorting a conversation by (place_turn, place_level, place_kind, turn) puts every result behind its call and every call
    behind those it comes after. `message` is the canonical JSON: {"content":...,"role":...} and, for calls or results,
    `tool_calls` or `tool_call_id`. calls counts the calls of a message; linked says that all its calls have a result, or
    that a result has a call, and is null for other messages. errors lists, sorted, unknown tools, wrong arguments,
    repeated identifiers, calls without result, results without call and cycles.

    A null text or role is JSON null. Text that isn't such an object is content. Of several calls with one identifier the
    first by turn, and in one turn the one whose list of predecessors sorts first, is linked and the others are errors; several results of one call all link. Repeated rows are messages
    each. A text of any length is one message. An empty table gives no rows. Only conv_id, turn, role and text are read.
    """
    base = messages.select("conv_id", "turn", "role", "text")
    maybe = F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    base = base.withColumn("json", maybe)
    base = base.withColumn("tool_calls", F.when(F.col("role") == "assistant", F.try_variant_get("json", "$.tool_calls", _CALL)))
    base = base.withColumn("result_of", F.when(F.col("role") == "tool", F.try_variant_get("json", "$.tool_call_id", "string")))
    base = base.withColumn("content", F.when(F.col("tool_calls").isNotNull() | F.col("result_of").isNotNull(), F.try_variant_get("json", "$.content", "string")).otherwise(F.col("text")))

    # calls and results are parsed once; the rest of the messages never leave their place
    special = base.where("size(tool_calls) > 0 or result_of is not null").withColumn("row", F.xxhash64("text"))
    special = materialise(special.select("conv_id", "turn", "role", "row", "content", "tool_calls", "result_of"), "chat-calls")
    calling = special.where("size(tool_calls) > 0")
    calls = calling.select("conv_id", "turn", F.explode("tool_calls").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    calls = calls.where("call_id is not null and conv_id is not null")
    first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("same"), F.min_by("after", F.struct("turn", "after")).alias("after"))
    first = materialise(first, "calls")
    results = special.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("call_id")).agg(F.count("*").alias("results"))
    facts = first.join(_levels(first), ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "call_turn", "same", "level", F.coalesce("results", F.lit(0)).alias("results"))

    # what the calls of a message say of it
    each = calling.select("conv_id", "turn", "row", F.explode("tool_calls").alias("c"))
    wrong = argument_errors(F.col("c.name"), F.col("c.arguments"), schemas)
    each = each.select("conv_id", "turn", "row", F.col("c.id").alias("call_id"), wrong.alias("wrong")).join(facts, ["conv_id", "call_id"], "left")
    label = F.coalesce("call_id", F.lit("?"))
    told = F.concat(
        F.transform("wrong", lambda e: F.concat(label, F.lit(": "), e)),
        F.array_compact(F.array(F.when(F.col("call_id").isNull(), "call without identifier"), F.when(F.col("same") > 1, F.concat(label, F.lit(": repeated identifier"))), F.when(F.coalesce("results", F.lit(0)) == 0, F.concat(label, F.lit(": no result"))), F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), F.concat(label, F.lit(": cycle"))))),
    )
    of_calls = each.groupBy("conv_id", "turn", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(told)))).alias("told"), F.max(F.coalesce("level", F.lit(NO_LEVEL))).alias("level"), F.min(F.coalesce("results", F.lit(0)) > 0).alias("all_linked"))

    plain = base.where("coalesce(size(tool_calls), 0) <= 0 and result_of is null").select("conv_id", "turn", "role", "content", F.col("turn").alias("place_turn"), F.lit(0).alias("place_level"), F.lit(0).alias("place_kind"), F.lit(0).alias("calls"), F.lit(None).cast("boolean").alias("linked"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("more"), F.lit(None).cast("string").alias("result_of"))
    one_call = F.transform("tool_calls", lambda c: F.concat(F.lit('{"after":'), F.coalesce(F.to_json(c["after"]), F.lit("[]")), F.lit(',"arguments":'), F.coalesce(F.to_json(c["arguments"]), F.lit("null")), F.lit(',"id":'), F.coalesce(json_string(c["id"]), F.lit("null")), F.lit(',"name":'), F.coalesce(json_string(c["name"]), F.lit("null")), F.lit("}")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("row") == F.col("x"))
    calling = calling.join(of_calls.withColumnsRenamed({"conv_id": "c", "turn": "t", "row": "x"}), same)
    calling = calling.select("conv_id", "turn", "role", "content", F.col("turn").alias("place_turn"), F.col("level").alias("place_level"), F.lit(1).alias("place_kind"), F.size("tool_calls").alias("calls"), F.col("all_linked").alias("linked"), F.col("told").alias("errors"), F.concat(F.lit("["), F.concat_ws(",", one_call), F.lit("]")).alias("more"), F.lit(None).cast("string").alias("result_of"))
    answer = special.where("result_of is not null").join(facts.withColumnRenamed("call_id", "result_of"), ["conv_id", "result_of"], "left")
    answer = answer.select("conv_id", "turn", "role", "content", F.greatest("turn", "call_turn").alias("place_turn"), F.coalesce(F.when(F.col("call_turn") >= F.col("turn"), F.col("level")), F.lit(0)).alias("place_level"), F.lit(2).alias("place_kind"), F.lit(0).alias("calls"), F.col("call_turn").isNotNull().alias("linked"), F.when(F.col("call_turn").isNull(), F.array(F.concat("result_of", F.lit(": no call")))).otherwise(F.array().cast("array<string>")).alias("errors"), F.lit(None).cast("string").alias("more"), "result_of")

    everything = reduce(DataFrame.unionByName, (plain, calling, answer))
    text = F.concat(
        F.lit('{"content":'), F.coalesce(json_string(F.col("content")), F.lit("null")), F.lit(',"role":'), F.coalesce(json_string(F.col("role")), F.lit("null")),
        F.when(F.col("result_of").isNotNull(), F.concat(F.lit(',"tool_call_id":'), json_string(F.col("result_of")))).otherwise(""),
        F.when(F.col("more").isNotNull(), F.concat(F.lit(',"tool_calls":'), "more")).otherwise(""), F.lit("}"),
    )
    return everything.select("conv_id", "turn", "place_turn", "place_level", "place_kind", "role", "calls", "linked", "errors", text.alias("message"))
