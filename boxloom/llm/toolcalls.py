"""Chat formatting: tool calls linked to their results, ordered, validated, and serialised.

Everything is DataFrame functions.  Calls and results meet in a hash join on (conversation,
identifier).  A call needs another when an argument's value is the object ``{"$call": identifier}``;
what a text says is never taken for one.  Calls come after the results that they need, and
otherwise keep their turn order.  Arguments are parsed into variants and checked, value by
value, against the rows of the tool's schema, and each message becomes one JSON line with sorted keys and
no spaces.  One row per message comes out, so a conversation of any length is never gathered.

Defined cases: of several calls (or results) with one identifier the first in turn order
counts.  A call without a result is ``unanswered``, a result without a call is an ``orphan``.
Calls on or behind a cycle of needs are ``cyclic``, calls that need an unknown identifier, or a
call that does, are ``dangling``; both have no level and keep their turn order after all others.
Arguments that are no JSON object (or larger than Spark's variants may be) are an error and are
serialised as a JSON string.  Null roles and texts become JSON null; null conversations form one
conversation; messages with a null turn are neither calls nor results and come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint, join_nulls

#: Turns of one bucket, for positions within a conversation.
BUCKET = 256
#: What a variant's type may be for each type of a schema.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
_NEED = r'^\{"\$call":"([^"\\]*)"\}$'


def json_string(col: Column) -> Column:
    """A JSON string with the shortest escapes; null becomes null."""
    s = F.to_json(F.struct(col.alias("v")))
    return F.when(col.isNull(), "null").otherwise(F.substring(s, 6, 1 << 30).substr(F.lit(1), F.length(s) - 6))


def parsed(arguments: Column) -> Column:
    """The arguments as a map of variants; null where they are no JSON object."""
    return F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")


def canonical_arguments(arguments: Column) -> Column:
    """The arguments as JSON with sorted keys, at every depth, and no spaces."""
    return F.when(parsed(arguments).isNotNull(), F.to_json(F.try_parse_json(arguments))).otherwise(json_string(arguments))


def _first(df: DataFrame) -> DataFrame:
    return df.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Joins calls (conv_id, call_id, turn) and results (conv_id, call_id, turn).

    Gives call_turn, result_turn and state: linked, unanswered or orphan.
    """
    r = _first(results).select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("turn").alias("result_turn"))
    c = _first(calls).withColumnRenamed("turn", "call_turn")
    both = c.join(r.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full")
    state = F.when(F.col("result_turn").isNull(), "unanswered").when(F.col("call_turn").isNull(), "orphan").otherwise("linked")
    conv = F.when(F.col("call_turn").isNull(), F.col("rc")).otherwise(F.col("conv_id"))
    return both.select(conv.alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"), "call_turn", "result_turn", state.alias("state"))


def references(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, needed: the calls whose results the argument values name."""
    values = calls.select("conv_id", "call_id", F.explode(parsed(F.col("arguments"))).alias("field", "value"))
    needed = F.regexp_extract(F.to_json("value"), _NEED, 1)
    return values.select("conv_id", "call_id", needed.alias("needed")).where("needed <> ''").distinct()


def levels(linked: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, call_id, level, ready, fate of every call: how late it has to come.

    ``linked`` comes from ``link``; ``needs`` has conv_id, call_id, needed.  Calls without needs are
    level 0, others one above the highest that they need; ``ready`` is the last turn among all that a call waits
    for; ``fate`` is cyclic, dangling or null.

    Calls with one need form chains, which pointer jumping shortens to their ends in as many
    rounds as the logarithm of their length.  What is left are calls with several needs;
    a round settles all of them whose needs are settled.
    """
    name = lambda c: F.concat_ws("/", F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), c)
    own = linked.where("call_turn is not null").select("conv_id", "call_id", name("call_id").alias("node"), F.greatest("call_turn", "result_turn").alias("t"))
    edges = needs.select(name("call_id").alias("node"), name("needed").alias("p"))
    if edges.isEmpty():
        return own.select("conv_id", "call_id", F.lit(0).alias("level"), F.lit(None).cast("long").alias("ready"), F.lit(None).cast("string").alias("fate"))
    own = checkpoint(own)
    at = own.select(F.col("node").alias("p"), F.col("t").alias("tp"))
    edges = checkpoint(edges.join(own.select("node"), "node", "left_semi").join(at, "p", "left"))
    # fates in order of weight: 0 none, 1 dangling, 2 cyclic
    nodes = own.join(edges.groupBy("node").agg(F.count("tp").alias("n"), F.max(F.col("tp").isNull().cast("int")).alias("f")), "node", "left")
    nodes = checkpoint(nodes.select("conv_id", "call_id", "node", "t", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0)).alias("f")))
    known = edges.where("tp is not null")
    # d steps lead to p; m is the last turn, f the heaviest fate, of the calls on the way
    jump = checkpoint(known.join(nodes.where("n = 1").select("node", "t", "f"), "node").select("node", "t", "f", "p", F.lit(1).alias("d"), F.lit(None).cast("long").alias("m")))
    count, rounds = jump.count(), 0
    while True:
        on = jump.select(F.col("node").alias("p"), *[F.col(c).alias(f"q{c}") for c in ("t", "f", "p", "d", "m")])
        both = jump.join(on, "p", "left")
        if 1 << rounds > count or both.where("qp is not null").isEmpty():
            break
        rounds += 1
        moved = F.col("qp").isNotNull()
        far = [F.coalesce("qp", "p").alias("p"), F.when(moved, F.col("d") + F.col("qd")).otherwise(F.col("d")).alias("d"), F.greatest("m", F.when(moved, F.greatest("qt", "qm"))).alias("m"), F.greatest("f", F.coalesce("qf", F.lit(0))).alias("f")]
        jump = checkpoint(both.select("node", "t", *far))
    # whoever still points at a chain goes in a circle
    chains = checkpoint(both.select("node", "t", "p", "d", "m", F.when(F.col("qp").isNotNull(), 2).otherwise(F.col("f")).alias("f")))
    ends = checkpoint(nodes.where("n = 0").select("node", F.lit(0).alias("level"), F.lit(None).cast("long").alias("ready"), "t", "f"))
    # edges of calls with several needs, led through chains to their ends
    several = nodes.where("n > 1").select("node", "t", "f")
    via = chains.select(F.col("node").alias("p"), F.col("p").alias("end"), F.col("d").alias("steps"), F.col("m").alias("late"), F.col("f").alias("ef"))
    short = known.join(several.select("node"), "node", "left_semi").join(via, "p", "left")
    short = checkpoint(short.select("node", F.coalesce("end", "p").alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.greatest("tp", "late").alias("late"), F.coalesce("ef", F.lit(0)).alias("ef")))
    waiting = checkpoint(several)
    while not waiting.isEmpty():
        e = short.join(waiting.select("node"), "node", "left_semi").join(ends.select(F.col("node").alias("end"), F.col("level").alias("l"), "ready", F.col("t").alias("te"), F.col("f").alias("fe")), "end", "left")
        e = e.groupBy("node").agg(F.count_if(F.col("l").isNull()).alias("open"), F.max(F.col("l") + F.col("steps")).alias("level"), F.max(F.greatest("late", "ready", "te")).alias("ready"), F.max(F.greatest("ef", F.coalesce("fe", F.lit(0)))).alias("ef"))
        ready = checkpoint(waiting.join(e.where("open = 0"), "node").select("node", "level", "ready", "t", F.greatest("f", "ef").alias("f")))
        if ready.isEmpty():
            ends = ends.unionByName(waiting.select("node", F.lit(0).alias("level"), F.lit(None).cast("long").alias("ready"), "t", F.lit(2).alias("f")))
            break
        ends = checkpoint(ends.unionByName(ready))
        waiting = checkpoint(waiting.join(ready.select("node"), "node", "left_anti"))
    e = ends.select(F.col("node").alias("p"), F.col("level").alias("l"), "ready", F.col("t").alias("te"), F.col("f").alias("fe"))
    led = chains.join(e, "p", "left").select("node", (F.col("l") + F.col("d")).alias("level"), F.greatest("m", "te", "ready").alias("ready"), "t", F.greatest("f", F.coalesce("fe", F.lit(2))).alias("f"))
    every = ends.unionByName(led).select("node", "level", "ready", "f")
    fate = F.when(F.col("f") == 2, "cyclic").when(F.col("f") == 1, "dangling")
    return own.join(every, "node").select("conv_id", "call_id", F.when(F.col("f") == 0, F.col("level")).alias("level"), F.when(F.col("f") == 0, F.col("ready")).alias("ready"), fate.alias("fate"))


def validate(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """conv_id, call_id, errors: what is wrong with the arguments, sorted; empty if nothing.

    ``schema`` has one row per tool and field: name, field, type (a key of ``TYPES``) and required.
    Fields that no row names are errors, as are unknown tools and types.  A value that names another
    call's result has any type.
    """
    key = ["conv_id", "call_id"]
    args = calls.select(*key, "name", parsed(F.col("arguments")).alias("args"))
    tools = schema.select("name").distinct().withColumn("known", F.lit(True))
    args = args.join(tools, "name", "left")
    value = F.col("args")[F.col("field")]
    pattern = F.lit(None)
    for k, v in TYPES.items():
        pattern = F.when(F.col("type") == k, f"^({v})$").otherwise(pattern)
    fits = F.regexp_like(F.schema_of_variant(value), F.coalesce(pattern, F.lit("^$"))) | F.regexp_like(F.to_json(value), F.lit(_NEED))
    expected = args.join(schema, "name").select(
        *key,
        F.when(value.isNull() & F.col("required"), F.concat(F.lit("missing:"), "field")).when(value.isNotNull() & ~fits, F.concat(F.lit("type:"), "field")).alias("error"),
    )
    given = args.select(*key, "name", F.explode(F.map_keys("args")).alias("field")).join(schema.select("name", "field"), ["name", "field"], "left_anti")
    extra = given.select(*key, F.concat(F.lit("unknown:"), "field").alias("error"))
    whole = args.select(*key, F.when(F.col("known").isNull(), "tool").when(F.col("args").isNull(), "json").alias("error"))
    errors = expected.unionByName(extra).unionByName(whole)
    return errors.groupBy(*key).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def positions(df: DataFrame, group: str, order: list[str], buckets: list[Column]) -> DataFrame:
    """Adds pos, from 0 within ``group`` by ``order``, rows of one order alike.

    Counts are aggregated to (group, bucket) first, so that no task sees the rows of a long
    conversation.  ``buckets`` must rise with ``order``.
    """
    names = [f"__bucket{k}" for k in range(len(buckets))]
    per = df.groupBy(group, *order).agg(F.count("*").alias("n")).withColumns(dict(zip(names, buckets, strict=True)))
    before = lambda by, last: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*last).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = per.groupBy(group, *names).agg(F.sum("n").alias("n")).withColumn("before", before([group], names)).drop("n")
    inside = per.withColumn("inside", before([group, *names], order)).drop("n")
    at = join_nulls(inside, earlier, [group, *names]).select(group, *order, (F.col("before") + F.col("inside")).alias("pos"))
    return join_nulls(df, at, [group, *order])


def ordered(messages: DataFrame) -> DataFrame:
    """Adds pos to messages (conv_id, turn, is_result, level, ready, fate): turns, but needs first."""
    late = F.col("fate").isNotNull()
    m = messages.withColumns({"__late": late, "__at": F.greatest("turn", "ready"), "__level": F.coalesce("level", F.lit(-1)), "__result": F.coalesce("is_result", F.lit(False))})
    m = positions(m, "conv_id", ["__late", "__at", "__level", "__result", "turn"], [F.col("__late"), F.floor(F.col("__at") / BUCKET)])
    return m.drop("__late", "__at", "__level", "__result")


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: a user turn asks, the assistant turn after it answers.

    The identifier of both is the turn of the question.  A question needs the exchange before
    it, which its argument ``history`` names.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    # a column and not a constant, so that joins on the tool stay equality joins
    asks = c.where("role = 'user' and turn is not null").withColumn("name", F.when(F.col("role") == "user", "reply"))
    turns = asks.select("conv_id", "turn").distinct()
    turns = positions(turns, "conv_id", ["turn"], [F.floor(F.col("turn") / BUCKET)])
    earlier = turns.select("conv_id", F.col("turn").alias("last"), (F.col("pos") + 1).alias("pos"))
    k = join_nulls(turns, earlier, ["conv_id", "pos"], "left").select("conv_id", "turn", F.col("last").cast("string").alias("last"))
    asks = join_nulls(asks, k, ["conv_id", "turn"])
    history = F.when(F.col("last").isNotNull(), F.create_map(F.lit("$call"), "last"))
    arguments = F.to_json(F.struct(history.alias("history"), "text"))
    asks = asks.select("conv_id", F.col("turn").cast("string").alias("call_id"), "name", arguments.alias("arguments"), "turn")
    answers = c.where("role = 'assistant' and turn is not null").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", "text")
    return asks, answers


#: The one tool of plain chats: name, field, type, required.
REPLY = [("reply", "history", "object", False), ("reply", "text", "string", True)]


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, call_id, state, level, valid, pos, json.

    Repeated rows are messages of their own; those of one turn are valid only if all are.
    """
    calls, results = exchanges(conversations)
    calls = checkpoint(calls)
    schema = conversations.sparkSession.createDataFrame(REPLY, "name string, field string, type string, required boolean")
    key = ["conv_id", "call_id"]
    linked = checkpoint(link(calls, results))
    errors = validate(calls, schema).select(*key, (F.size("errors") == 0).alias("right"))
    linked = join_nulls(linked, errors, key, "left")
    linked = join_nulls(linked, levels(linked, references(calls)), key, "left").where("call_id is not null")
    role = F.col("role")
    call_id = F.when(role == "user", F.col("turn")).when(role == "assistant", F.col("turn") - 1).cast("string")
    m = conversations.select("conv_id", "turn", "role", "text", call_id.alias("call_id"), (role == "assistant").alias("is_result"))
    m = join_nulls(m, linked, key, "left")
    # what a repeated or null row says of itself: its own arguments, with the need that its turn has
    needed = references(calls).groupBy(*key).agg(F.min("needed").alias("needed"))
    m = join_nulls(m, needed, key, "left")
    asks = (role == "user") & F.col("turn").isNotNull()
    history = F.when(F.col("needed").isNotNull(), F.create_map(F.lit("$call"), "needed"))
    arguments = F.when(asks, canonical_arguments(F.to_json(F.struct(history.alias("history"), "text"))))
    state = F.coalesce("fate", "state")
    m = m.withColumns({"state": state, "valid": F.when(role == "user", F.col("right")), "__arguments": arguments})
    content = F.when(F.col("__arguments").isNull(), json_string(F.col("text")))
    name = F.when(F.col("__arguments").isNotNull(), F.lit('"reply"'))
    parts = [("arguments", F.col("__arguments")), ("content", content), ("id", json_string(F.col("call_id"))), ("name", name), ("role", json_string(role)), ("state", json_string(F.col("state"))), ("turn", F.coalesce(F.col("turn").cast("string"), F.lit("null")))]
    json = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts]), F.lit("}"))
    return ordered(m.withColumn("json", json)).select("conv_id", "turn", "role", "call_id", "state", "level", "valid", "pos", "json")
