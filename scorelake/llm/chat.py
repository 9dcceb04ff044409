"""Tool-call linking for chat transcripts, in DataFrame functions only.

Calls and results are hash-joined by their identifier within a conversation, ordered along "after" references, checked
against the schemas of their tools and written as canonical JSON. The library has no records of tool use of its own, so
the operator is general: any transcript with calls and results as rows will do.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.exchange import written
from scorelake.plans.skew import ordered

#: JSON types by the name that Spark gives to a variant's type.
TYPE_NAMES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
    "null": "^VOID$",
}


#: The tokens of a JSON text outside its strings: numbers, and all between.
TOKENS = "-?[0-9][0-9.eE+-]*|[^0-9-]+|-"


def canonical_numbers(text: Column) -> Column:
    """JSON text with equal numbers written alike: as plain decimals where 20 digits before and 18 behind the point hold them
    exactly (as a double does), otherwise as Spark writes the double; a number of digits only stays as it is."""

    def number(token: Column) -> Column:
        fixed, double = token.try_cast("decimal(38,18)"), token.try_cast("double")
        plain = F.regexp_replace(F.regexp_replace(fixed.cast("string"), r"\.?0+$", ""), "^-0$", "0")
        exact = F.coalesce(fixed.cast("double") == double, F.lit(False))
        return F.when(token.rlike("^-?[0-9]+$"), F.when(token == "-0", "0").otherwise(token)).when(exact, plain).otherwise(double.cast("string"))

    # quotes that aren't escaped part the text: what stands at odd places is inside a string
    marked = F.regexp_replace(text, r"\\.", "\u0000$0")
    parts = F.split(marked, '(?<!\u0000\\\\)"')
    tokens = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(TOKENS), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), F.coalesce(number(t), t)).otherwise(t)), "")
    alike = F.transform(parts, lambda x, i: F.when(i % 2 == 0, tokens(x)).otherwise(F.translate(x, "\u0000", "")))
    return F.array_join(alike, '"')


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """What is wrong with the arguments (JSON text) of a call, as an array of texts in a fixed order.

    ``schemas``: by tool, ``properties`` (name -> JSON type), ``required`` (names) and ``additional`` (whether other
    properties may stand there, true by default).
    """
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).rlike("^OBJECT<")

    def of_tool(schema: Mapping) -> Column:
        checks = []
        required, properties = list(schema.get("required", ())), dict(schema.get("properties", {}))
        keys = F.json_object_keys(arguments)
        for prop in sorted({*required, *properties}):
            there = F.array_contains(keys, prop)
            if prop in required:
                checks.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"{prop}: missing")))
            if prop in properties:
                kind = F.schema_of_variant(F.try_variant_get(value, f"$[{json.dumps(prop)}]", "variant"))
                wrong = there & ~F.coalesce(kind.rlike(TYPE_NAMES[properties[prop]]), F.lit(False))
                checks.append(F.when(wrong, F.lit(f"{prop}: not {properties[prop]}")))
        found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
        if not schema.get("additional", True):
            extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, properties)).cast("array<string>")))
            found = F.concat(found, F.transform(extra, lambda k: F.concat(k, F.lit(": unknown"))))
        return found

    said = F.when(value.isNull(), F.array(F.lit("arguments: not JSON"))).when(~is_object, F.array(F.lit("arguments: not an object")))
    for tool, schema in schemas.items():
        said = said.when(name == tool, of_tool(schema))
    return said.otherwise(F.array(F.lit("name: no such tool")))


def _depths(nodes: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, id, after) with ``depth``: how many calls come before along the references; null in a cycle.

    References double their reach in each round, so rounds grow with the logarithm of the longest chain.
    """
    known = nodes.select("conv_id", F.col("id").alias("after"), F.lit(True).alias("there"))
    state = nodes.join(known, ["conv_id", "after"], "left").select(
        "conv_id", "id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")
    )
    state = written(state, "chat-depths")
    most = state.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    reach = 1
    while reach <= most and not state.filter("up is not null").isEmpty():
        above = state.select("conv_id", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "up"], "left")
        state = written(joined.select("conv_id", "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chat-depths")
        reach *= 2
    return state.select("conv_id", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Link the tool calls of conversations to their results.

    ``messages``: (``conv_id``, ``turn``, ``kind`` 'call' or 'result', ``call_id``, ``name``, ``content``, ``after_id``), where the
    content of a call is the JSON text of its arguments and ``after_id`` names a call that has to come before it; other
    columns are dropped. ``schemas``: as in ``argument_errors``.

    Returns one row per call id: (conv_id, position, call_id, turn, result_turn, name, depth, status, n_calls, n_results, errors, json).
    ``position`` numbers the rows of a conversation by (depth, turn, result_turn, call_id), null last: a call follows the one it names. ``depth`` counts the calls before
    it along ``after_id``; a reference to no call of the conversation counts as none, and calls in a cycle of
    references, or behind one, have a null depth. ``status``: linked, open (a call without result) or orphan (a result without call).
    ``json`` is canonical: keys in order, no spaces, equal numbers alike (``canonical_numbers``); arguments that aren't JSON stand there as text.

    A null call_id makes a message an id of its own, ``#`` and its turn (``#`` alone if that is null, too), which links to nothing, also if another
    message bears that name. Of several calls, or results, with one id the first by
    (turn, content) counts, and ``n_calls`` and ``n_results`` tell. Messages without conv_id or of another kind are
    left out. A null content of a call isn't JSON; that of a result is a null. Empty tables give an empty result.
    """
    # given ids and those made here can't meet: "=a" is a given one, "#c5" a call's own
    own = F.concat(F.lit("#"), F.substring("kind", 1, 1), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    rows = messages.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "kind", F.coalesce(F.concat(F.lit("="), F.col("call_id").cast("string")), own).alias("id"), "name", "content",
        F.concat(F.lit("="), F.col("after_id").cast("string")).alias("after"),
    )
    order = F.struct("turn", "content")
    calls = (
        rows.filter("kind = 'call'")
        .groupBy("conv_id", "id")
        .agg(F.min_by(F.struct("turn", "name", "content", "after"), order).alias("call"), F.count("*").alias("n_calls"))
    )
    results = (
        rows.filter("kind = 'result'")
        .groupBy("conv_id", "id")
        .agg(F.min_by(F.struct("turn", "content"), order).alias("result"), F.count("*").alias("n_results"))
    )
    depths = _depths(calls.select("conv_id", "id", F.col("call.after").alias("after")))
    linked = calls.join(results, ["conv_id", "id"], "full").join(depths, ["conv_id", "id"], "left")

    arguments = F.col("call.content")
    errors = F.when(F.col("call").isNull(), F.array(F.lit("call: missing"))).otherwise(argument_errors(F.col("call.name"), arguments, schemas))
    body = F.coalesce(F.try_parse_json(F.when(F.try_parse_json(arguments).isNotNull(), canonical_numbers(arguments))), arguments.cast("variant"))
    shown = F.when(F.col("id").startswith("="), F.substr("id", F.lit(2))).otherwise(F.concat(F.lit("#"), F.substr("id", F.lit(3))))
    record = F.struct(
        body.alias("arguments"), shown.alias("id"), F.col("call.name").alias("name"), F.col("result.content").alias("result")
    )
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "open").otherwise("linked")
    out = linked.select(
        "conv_id",
        shown.alias("call_id"),
        F.col("call.turn").alias("turn"),
        F.col("result.turn").alias("result_turn"),
        F.col("call.name").alias("name"),
        "depth",
        status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        errors.alias("errors"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("json"),
    )
    last = F.lit(2**63 - 1)
    by = [F.coalesce("depth", last), F.coalesce(F.col("turn").cast("long"), last), F.coalesce(F.col("result_turn").cast("long"), last), F.col("call_id")]
    out = ordered(written(out, "chat-linked"), ["conv_id"], by, number="position")
    return out.select("conv_id", "position", *(c for c in out.columns if c not in ("conv_id", "position")))
