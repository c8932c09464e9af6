"""Tool-call linking, in DataFrame functions alone.

Calls and their results meet in a hash join on the call's identifier, after each side is folded to one row for each
identifier, so that no identifier multiplies rows. The calls are ordered topologically by peeling: a call's level is 0
if it needs no other, and otherwise one more than the largest level among the calls that it needs; each round settles
the calls all of whose needs are settled. Arguments are parsed, validated against the tool's schema, and written as
canonical JSON: keys sorted at every depth, no white space.

Defined results: a call without an identifier, or whose identifier an earlier call (by conversation, turn, then
arguments) has, links to nothing and is marked in `problems`; of several results of an identifier the earliest turn
counts, then the smallest content; needs that name no call are ignored; calls on a cycle, and those that need one, have
no level; arguments that are null, no JSON, or no object are a problem and have no canonical form; a null turn sorts
last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldtext.llm.common import WORD, materialize

#: Arguments of a tool: name -> (type, required, least, most). Types: string, integer, number, boolean, array, object.
#: least and most bound a number's value or a string's length; None leaves the side open.
Schema = dict[str, tuple[str, bool, float | None, float | None]]

_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}


def _argument_problems(parsed: Column, name: str, kind: str, required: bool, least: float | None, most: float | None) -> list[Column]:
    value = F.try_variant_get(parsed, f"$['{name}']", "variant")
    missing = value.isNull()
    fits = F.schema_of_variant(value).rlike(_TYPES[kind])
    out = [F.when(missing, F.lit(f"missing:{name}"))] if required else []
    out.append(F.when(~missing & ~fits, F.lit(f"type:{name}")))
    if kind == "string":
        size = F.length(F.try_variant_get(parsed, f"$['{name}']", "string")).cast("double")
    else:
        size = F.try_variant_get(parsed, f"$['{name}']", "double")
    beyond = F.lit(False)
    if least is not None:
        beyond = beyond | (size < least)
    if most is not None:
        beyond = beyond | (size > most)
    out.append(F.when(~missing & fits & beyond, F.lit(f"range:{name}")))
    return out


def argument_problems(tool: Column, text: Column, parsed: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with the arguments, as an array of strings."""
    keys = F.json_object_keys(text)
    out = F.array(F.lit("tool"))
    for name, schema in sorted(schemas.items()):
        found = [c for arg, (kind, required, least, most) in sorted(schema.items()) for c in _argument_problems(parsed, arg, kind, required, least, most)]
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in schema])), lambda k: F.concat(F.lit("unknown:"), k))
        out = F.when(tool == name, F.concat(F.array_compact(F.array(*found)), F.array_sort(unknown))).otherwise(out)
    return F.when(keys.isNull(), F.array(F.lit("json"))).otherwise(out)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, level) of all call_id of calls, level null on or behind a cycle; needs: (call_id, needed)."""
    known = calls.select("call_id")
    edges = needs.where("call_id <> needed or call_id is null or needed is null").distinct()
    loops = needs.where("call_id = needed").select("call_id").distinct()
    edges = edges.join(known, "call_id", "left_semi").join(known.select(F.col("call_id").alias("needed")), "needed", "left_semi")
    edges = materialize(edges.unionByName(loops.select("call_id", F.col("call_id").alias("needed"))))
    waiting = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("level"))
    new = materialize(known.join(waiting, "call_id", "left_anti").withColumn("level", F.lit(0)))
    done = [new]
    while not new.isEmpty():
        # Only what was settled last can settle more; each need counts once.
        met = edges.join(new.select(F.col("call_id").alias("needed"), "level"), "needed")
        met = met.groupBy("call_id").agg(F.count(F.lit(1)).alias("met"), (F.max("level") + 1).alias("least"))
        after = waiting.join(met, "call_id", "left").withColumn("n", F.col("n") - F.coalesce("met", F.lit(0)))
        after = materialize(after.select("call_id", "n", F.greatest("level", F.coalesce("least", F.lit(0))).alias("level")))
        new, waiting = after.where("n = 0").select("call_id", "level"), after.where("n > 0")
        done.append(new)
        if len(done) == 16:
            done = [materialize(functools.reduce(DataFrame.unionByName, done))]
    return known.join(functools.reduce(DataFrame.unionByName, done), "call_id", "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per call.

    calls: conv_id, turn, call_id, tool, arguments (JSON), needs (array of identifiers); results: turn, call_id, content.
    Gives conv_id, turn, call_id, tool, linked, result_turn, n_results, level, valid, problems, arguments (canonical)
    and message: the call with its result as canonical JSON.
    """
    rows = materialize(
        calls.select("conv_id", "turn", "call_id", "tool", F.col("arguments").alias("text"), "needs", F.try_parse_json("arguments").alias("parsed"))
        .withColumn("place", F.struct(F.coalesce("conv_id", F.lit(2**63 - 1)), F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)), F.coalesce("text", F.lit(""))))
        .withColumn("arguments", F.when(F.json_object_keys("text").isNotNull(), F.to_json("parsed")))
        .withColumn("problems", argument_problems(F.col("tool"), F.col("text"), F.col("parsed"), schemas))
        .drop("parsed")
    )
    first = rows.where("call_id is not null").groupBy("call_id").agg(F.min("place").alias("first"))
    needs = rows.join(first, "call_id").where(F.col("place") == F.col("first")).select("call_id", F.explode("needs").alias("needed"))
    order = levels(first, needs)
    folded = results.where("call_id is not null").groupBy("call_id").agg(
        F.min(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"), "content")).alias("result"),
        F.count(F.lit(1)).alias("n_results"),
    )
    facts = first.join(order, "call_id").join(folded, "call_id", "left")
    out = rows.join(facts.hint("shuffle_hash"), "call_id", "left")
    own = F.col("call_id").isNotNull() & (F.col("place") == F.col("first"))
    linked = F.coalesce(own & F.col("n_results").isNotNull(), F.lit(False))
    problems = F.concat(
        F.when(F.col("call_id").isNull(), F.array(F.lit("id"))).when(~own, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")),
        F.col("problems"),
    )
    out = out.select(
        "conv_id", "turn", "call_id", "tool", linked.alias("linked"),
        F.when(linked, F.nullif(F.col("result.turn"), F.lit(2**63 - 1))).alias("result_turn"),
        F.coalesce(F.when(own, F.col("n_results")), F.lit(0)).cast("long").alias("n_results"),
        F.when(own, F.col("level")).cast("long").alias("level"),
        (F.size(problems) == 0).alias("valid"), F.array_join(problems, ",").alias("problems"), "arguments",
        F.when(linked, F.col("result.content")).alias("content"),
    )
    message = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("content").alias("result"), F.col("tool").alias("tool")
        ),
        {"ignoreNullFields": "false"},
    )
    return out.withColumn("message", message).drop("content")


#: The tools of the query: a first request, and a request that goes back to an earlier one.
TOOLS: dict[str, Schema] = {
    "ask": {"text": ("string", True, 1, 400), "words": ("integer", True, 1, 60)},
    "ask_again": {"text": ("string", True, 1, 400), "words": ("integer", True, 1, 60), "about": ("string", True, 3, None)},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of dialogues: a user's turn calls, the assistant's next turn is its result.

    A call's identifier is conversation:turn. After the first two turns it needs the call at half its turn.
    """
    at = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    back = F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string"))
    again = F.coalesce(F.col("turn") >= 2, F.lit(False))
    text = F.coalesce("text", F.lit(""))
    quoted = F.substring(F.to_json(F.struct(text.alias("text"))), 2, 2**31 - 1)
    words = F.regexp_count(text, F.lit(WORD)).cast("string")
    asked = F.concat(F.lit('{"words" : '), words, F.when(again, F.concat(F.lit(', "about": "'), back, F.lit('"'))).otherwise(""), F.lit(", "), quoted)
    calls = conversations.where("role = 'user'").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(known, at).alias("call_id"),
        F.when(again, "ask_again").otherwise("ask").alias("tool"), asked.alias("arguments"),
        F.when(again & known, F.array(back)).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    answered = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = conversations.where("role = 'assistant'").select(
        F.col("turn").cast("long").alias("turn"), F.when(known, answered).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def link_conversations(conversations: DataFrame) -> DataFrame:
    calls, results = conversation_calls(conversations)
    return link_calls(calls, results, TOOLS)
