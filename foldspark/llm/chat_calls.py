"""Tool calls and results from plain conversations, for tables that have none. DataFrame functions only.

Every message stays as it is. Each question also becomes a call, which comes after the question before it, and each answer
also the result of the call before it. What the texts' lengths n say makes the calls unlike: the tool and its arguments
(some of the wrong kind, some missing), identifiers that occur twice, dependencies on two calls, on a later one and so in a
cycle, results of no call, and results that come before their call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOLS = ("search", "calculator", "fetch", "python", "translate")


def json_string(text: Column) -> Column:
    """The JSON string of a text; null for null."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def _object(**members: Column) -> Column:
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def with_calls(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages at even turns, calls and results at odd ones.

    The call of the question at turn t is `q` and t, the first one's where n is a multiple of 13. It comes after the call of
    turn t - 2; after none (multiples of 7), after those of t - 2 and t - 4 (of 19), after that of t + 2 (of 17). The answer
    at turn t is the result of the call of t - 1, or of an unknown one (multiples of 11), and stands before it where n is a
    multiple of 5. Rows of other roles are messages only. A null text is an empty one in calls and results. An empty table
    gives no rows. Only conv_id, turn, role and text are read.
    """
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    text, n, turn = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))), F.col("turn")

    def call(at: Column) -> Column:
        return F.concat(F.lit("q"), at.cast("string"))

    odd, string = n % 3 == 0, json_string(text)
    number = n.cast("string")
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), n % len(TOOLS) + 1)
    arguments = (
        F.when(tool == "search", _object(query=string, limit=F.when(odd, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)))
        .when(tool == "calculator", F.when(odd, _object(formula=string)).otherwise(_object(expression=string)))
        .when(tool == "fetch", F.when(odd, string).otherwise(_object(timeout=F.concat(number, F.lit(".5")), url=string)))
        .when(tool == "python", _object(code=string))
        .otherwise(_object(text=string))
    )
    after = (
        F.when(n % 7 == 0, F.array().cast("array<string>"))
        .when(n % 19 == 0, F.array(call(turn - 2), call(turn - 4)))
        .when(n % 17 == 0, F.array(call(turn + 2)))
        .otherwise(F.array(call(turn - 2)))
    )
    name = F.when(n % 13 == 0, F.lit("q0")).otherwise(call(turn))
    one = _object(id=json_string(name), name=json_string(tool), arguments=arguments, after=F.to_json(after))
    calls = base.where("role = 'user' and turn is not null")
    calls = calls.select("conv_id", (turn * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit('{"tool_calls":['), one, F.lit("]}")).alias("text"))
    of = F.when(n % 11 == 0, F.concat(F.lit("x"), turn.cast("string"))).otherwise(call(turn - 1))
    place = turn * 2 + F.when(n % 5 == 0, -3).otherwise(1)
    results = base.where("role = 'assistant' and turn is not null")
    results = results.select("conv_id", place.alias("turn"), F.lit("tool").alias("role"), _object(tool_call_id=json_string(of), content=string).alias("text"))
    return base.withColumn("turn", turn * 2).unionByName(calls).unionByName(results)
