"""Chat formatting: tool calls linked to results, ordered, validated, and written as canonical JSON.

All in DataFrame functions. Results and calls are linked on narrow rows, by
hash joins on identifiers; the records with their texts are shuffled once, to
meet what was found. Calls may depend on other calls: chains of calls that
depend on one other each are followed by doubling steps, what merges several is
taken layer by layer, so a conversation is read in the order (level, seq).
Arguments are checked against the schema of the called function. Every record
is one JSON object with sorted keys and no white space.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Kinds of a schema's values, and what they are as variants.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

#: name: {parameter: (kind, required)}
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

#: The function that a user's turn is taken to call.
TURN_SCHEMAS: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def arguments_problem(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with JSON ``arguments`` for function ``name``; null if nothing is."""
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    problem = F.lit("unknown function")
    for function, parameters in schemas.items():
        found = F.lit(None).cast("string")
        for key, (kind, required) in sorted(parameters.items(), reverse=True):
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$['{key}']", "variant"))
            right = F.lit(False)
            for start in KINDS[kind]:
                right = right | value.startswith(start)
            there = F.array_contains(keys, key)
            wrong = F.when(there & ~F.coalesce(right, F.lit(False)), F.lit(f"{key}: not {kind}"))
            if required:
                wrong = wrong.when(~there, F.lit(f"{key}: missing"))
            found = F.coalesce(wrong, found)
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in sorted(parameters)]).cast("array<string>"))
        found = F.coalesce(found, F.when(F.size(extra) > 0, F.concat(F.array_min(extra), F.lit(": not a parameter"))))
        problem = F.when(name == function, found).otherwise(problem)
    whole = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(~F.coalesce(whole, F.lit(False)), F.lit("not a JSON object")).otherwise(problem)


def _hashed(df: DataFrame) -> DataFrame:
    """``df``, narrow rows, to be the built side of a hash join."""
    return df.hint("shuffle_hash")


def _ids(records: DataFrame) -> DataFrame:
    """Each conversation's identifiers: how many calls and results name them, and where the first of each stands."""
    call = F.col("kind") == "call"
    return records.where("id is not null and kind in ('call', 'result')").groupBy("conv", "id").agg(
        F.sum(call.cast("long")).alias("calls"), F.sum((~call).cast("long")).alias("results"), F.min(F.when(call, F.col("seq"))).alias("first_call"), F.min(F.when(~call, F.col("seq"))).alias("first_result")
    )


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of each call of ``calls`` (conv_id, id, depends_on).

    A call without dependencies in its conversation is at level 0, any other
    one above the highest it depends on; null where dependencies form a circle.
    Null conversations are one.
    """
    found = _levels(calls.withColumn("conv", F.struct("conv_id")))
    return found.select("conv.conv_id", "id", "level")


def _levels(calls: DataFrame) -> DataFrame:
    """conv, id and level of ``calls`` (conv, id, depends_on); see ``levels``.

    Calls of one dependency point to it. Pointers are doubled until they end at
    a call of none or of several, in a number of rounds that is the logarithm
    of the longest chain; a pointer that doesn't within the logarithm of all
    calls runs in a circle. Calls of several follow layer by layer, one round
    for each nesting of them.
    """
    key = ["conv", "id"]
    nodes = cut(calls.select(*key).distinct())
    edges = calls.select(*key, F.explode("depends_on").alias("on")).distinct()
    edges = cut(edges.join(_hashed(nodes.withColumnRenamed("id", "on")), ["conv", "on"], "left_semi"))
    needs = cut(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("needs"), F.min("on").alias("top")))
    ends = nodes.join(_hashed(needs), key, "left_anti").withColumn("level", F.lit(0))
    # Pointers: top is what a call leads to, dist how far that is.
    pointers = needs.where("needs = 1").select(*key, "top", F.lit(1).alias("dist"))
    open_ = cut(pointers.withColumn("open", F.lit(True)))
    settled = open_.limit(0)
    rounds = open_.count().bit_length() + 1
    for _ in range(rounds):
        # A pointer whose end is itself one of the pointers goes on from there.
        onward = settled.unionByName(open_).select("conv", F.col("id").alias("top"), F.col("top").alias("next"), F.col("dist").alias("more"))
        step = open_.join(_hashed(onward), ["conv", "top"], "left")
        moved = cut(step.select("conv", "id", F.coalesce("next", "top").alias("top"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("open")))
        settled, open_ = cut(settled.unionByName(moved.where("not open"))), moved.where("open")
        if open_.isEmpty():
            break
    chains = settled.select(*key, "top", "dist")
    several = needs.where("needs > 1").select(*key, "needs")
    done = cut(ends)
    if not several.isEmpty():
        # What a call of several waits for: the ends of its dependencies' chains.
        waits = edges.join(_hashed(several.select(*key)), key, "left_semi")
        tails = chains.select("conv", F.col("id").alias("on"), F.col("top").alias("tail"), "dist")
        circles = open_.select("conv", F.col("id").alias("on"), F.lit(True).alias("circle"))
        waits = waits.join(_hashed(tails), ["conv", "on"], "left").join(_hashed(circles), ["conv", "on"], "left").where("circle is null")
        waits = cut(waits.select(*key, F.coalesce("tail", "on").alias("tail"), F.coalesce("dist", F.lit(0)).alias("dist")))
        left = several
        while True:
            met = waits.join(_hashed(done.select("conv", F.col("id").alias("tail"), "level")), ["conv", "tail"])
            met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("level") + F.col("dist")).alias("highest"))
            ready = cut(left.join(_hashed(met), key).where("met = needs").select(*key, (F.col("highest") + 1).cast("int").alias("level")))
            if ready.isEmpty():
                break
            done = cut(done.unionByName(ready))
            left = cut(left.join(_hashed(ready), key, "left_anti"))
    known = done.unionByName(chains.join(_hashed(done.select("conv", F.col("id").alias("top"), "level")), ["conv", "top"]).select(*key, (F.col("level") + F.col("dist")).cast("int").alias("level")))
    return nodes.join(_hashed(known), key, "left").select(*key, "level")


def marks(records: DataFrame) -> DataFrame:
    """conv, seq, kind, id, level and status of ``records`` (conv_id, seq, kind, id, depends_on), once each, written; conv holds conv_id."""
    rows = records.select(F.struct("conv_id").alias("conv"), "seq", "kind", "id", "depends_on")
    own = _levels(rows.where("kind = 'call' and id is not null").select("conv", "id", "depends_on"))
    own = cut(own)
    ids = _ids(rows).join(_hashed(own.withColumnRenamed("level", "own")), ["conv", "id"], "left")
    # Records that are no calls may depend on calls as well.
    after = rows.where("kind <> 'call' or id is null").select("conv", "seq", "kind", "id", F.explode("depends_on").alias("on")).distinct()
    after = after.join(_hashed(own.select("conv", F.col("id").alias("on"), "level")), ["conv", "on"]).groupBy("conv", "seq", "kind", "id").agg((F.max("level") + 1).alias("after"))
    rows = rows.select("conv", "seq", "kind", "id").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ("conv", "seq", "kind", "id")]
    joined = rows.join(_hashed(ids), ["conv", "id"], "left").join(_hashed(after.select(*[F.col(c).alias(f"a_{c}") for c in ("conv", "seq", "kind", "id")], "after")), _all(same), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    has_call = F.coalesce(F.col("calls") > 0, F.lit(False))
    first = F.when(call, F.col("seq") == F.col("first_call")).otherwise(F.col("seq") == F.col("first_result"))
    status = (
        F.when(F.coalesce(~call & ~result, F.lit(True)), "message")
        .when(result & ~has_call, "orphan")
        .when(F.coalesce(~first, F.lit(False)), "repeated")
        .when(result, "linked")
        .when(F.col("id").isNotNull() & F.col("own").isNull(), "circular")
        .when(F.coalesce(F.col("results") > 0, F.lit(False)), "answered")
        .otherwise("unanswered")
    )
    level = F.when(call & F.col("id").isNotNull(), F.col("own")).when(result & has_call, F.col("own") + 1).otherwise(F.coalesce("after", F.lit(0)))
    return cut(joined.select("conv", "seq", "kind", "id", level.cast("int").alias("level"), status.alias("status")))


def _all(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole & c
    return whole


def _serialised(records: DataFrame, found: DataFrame, schemas: Schemas) -> DataFrame:
    """``records`` with what ``marks`` found for them."""
    found = _hashed(found.select(*[F.col(c).alias(f"m_{c}") for c in ("conv", "seq", "kind", "id")], "level", "status"))
    records = records.withColumn("conv", F.struct("conv_id"))
    joined = records.join(found, _all([F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in ("conv", "seq", "kind", "id")]))
    problem = F.when(F.col("kind") == "call", arguments_problem(F.col("name"), F.col("arguments"), schemas))
    canonical = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "content", F.col("conv_id").alias("conversation"), "id", "name", "role", F.col("seq").alias("turn")))
    return joined.select("conv_id", "seq", "kind", "id", "level", "status", problem.alias("problem"), canonical.alias("json"))


def link(records: DataFrame, schemas: Schemas) -> DataFrame:
    """Link, order, validate and serialise ``records``.

    ``records``: conv_id, seq, kind (call, result or message), role, id, name,
    arguments (JSON text), content and depends_on (array of ids). Returns
    conv_id, seq, kind, id, level, status, problem and json of every record.

    status: of calls answered, unanswered or circular; of results linked or
    orphan (no call of that id, or one without an id); of others message.
    ``repeated`` replaces it where an id has several calls, or several results
    and this one isn't the first. level: a call's, one more for its result; of
    other records one above the highest call they depend on, 0 without; null in
    circles. Null arguments, texts and ids are JSON nulls left out; repeated
    rows stay rows. Records with null conversations are linked as one. Very
    long texts pass unread. Other columns are ignored; an empty table gives no
    rows.
    """
    records = records.select("conv_id", "seq", "kind", "role", "id", "name", "arguments", "content", "depends_on")
    return _serialised(records, marks(records), schemas)


def calls_before(turns: DataFrame) -> DataFrame:
    """conv, turn and before (the turn of the last call before it, if any) of each distinct turn of ``turns`` (conv, turn, call).

    Turns are dealt by ranges of conversation and turn, so a conversation of
    any length is spread over tasks; a range takes over from those before it.
    """
    distinct = turns.groupBy("conv", "turn").agg(F.max("call").alias("call"))
    ranged = cut(distinct.repartitionByRange("conv", "turn").withColumn("range", F.spark_partition_id()))
    called = F.when(F.col("call"), F.struct("conv", "turn"))
    # One row a range: the last call in it, and of all ranges before it.
    ends = ranged.groupBy("range").agg(F.max(called).alias("end"))
    carried = ends.select("range", F.max("end").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = F.max(called).over(Window.partitionBy("range").orderBy("conv", "turn").rowsBetween(Window.unboundedPreceding, -1))
    last = F.coalesce("within", "carried")
    found = ranged.withColumn("within", within).join(_hashed(carried), "range")
    return found.select("conv", "turn", F.when(last["conv"] == F.col("conv"), last["turn"]).alias("before"))


def _name(turn: Column) -> Column:
    return F.concat(F.lit("turn-"), turn.cast("string"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Records of plain ``turns`` (conv_id, turn, role, text), but for what they depend on.

    A user's turn calls ``reply`` with its text; an assistant's turn is the
    result of the turn before it; any other turn is a message.
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    turn = F.col("turn").cast("long")
    none = F.lit(None).cast("string")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), turn.alias("turn")))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        turn.alias("seq"),
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, _name(turn)).when(assistant, _name(turn - 1)).alias("id"),
        F.when(user, "reply").alias("name"),
        F.when(user, arguments).otherwise(none).alias("arguments"),
        F.when(user, none).otherwise(F.col("text")).alias("content"),
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """``link`` of plain turns, each of which depends on the last call before it in its conversation.

    So the order (level, seq) is the order of the turns. A turn without a
    number depends on none.
    """
    records = from_turns(turns)
    narrow = cut(records.select(F.struct("conv_id").alias("conv"), "seq", "kind", "id").distinct())
    before = calls_before(narrow.where("seq is not null").select("conv", F.col("seq").alias("turn"), (F.col("kind") == "call").alias("call")))
    on = F.when(F.col("before").isNotNull(), F.array(_name(F.col("before")))).otherwise(F.array().cast("array<string>"))
    chained = narrow.join(_hashed(before.withColumnRenamed("turn", "seq")), ["conv", "seq"], "left").select("conv.conv_id", "seq", "kind", "id", on.alias("depends_on"))
    return _serialised(records, marks(cut(chained)), TURN_SCHEMAS)
