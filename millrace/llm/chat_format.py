"""Chat formatting with linked tool calls.

Calls and results are joined by conversation and call identifier, ordered so that every call follows the calls whose
results it cites and every result its call, checked against the tools' argument schemas, and written as canonical
JSON lines (keys sorted, no spaces). A line holds one record: a plain message, a call with its result, or a result
without a call. Lines carry their order (level, turn), so no task has to hold a whole conversation.

All steps are DataFrame operations; JSON is parsed as variants.

Defined cases: a null or malformed argument text is kept as null with the fault `not an object`; calls that repeat an
identifier are all kept, each with the result; of results that repeat an identifier the least text is the result, and
n_results counts them, and with repeats=True each further one is a record of its own (`repeated result`, as is every
exact copy); calls that cite each other in a circle, or cite a call of such a circle, have level null and
the status `circular`; citations of unknown calls count as none; a null text is written as null; null identifiers
link nothing; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.operators.timeseries import carry

#: Turns of a conversation that one task holds in order; a longer conversation is carried on from part to part.
TURNS = 1024

#: JSON types of a schema as patterns of variants' SQL types.
_TYPES = {
    "string": "^STRING$",
    "integer": "^(TINYINT|SMALLINT|INT|BIGINT)$",
    "number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<.*>$",
    "array": "^ARRAY<.*>$",
}


@dataclass(frozen=True)
class Property:
    """One argument: its JSON type, whether it has to be there, bounds of a number, least length of a string."""

    kind: str
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None


@dataclass(frozen=True)
class Tool:
    name: str
    properties: dict[str, Property] = field(default_factory=dict)


def argument_faults(tools: list[Tool], tool: Column, arguments: Column) -> Column:
    """array<string> of what is wrong with JSON arguments by the tool's schema, in order of the properties' names."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike(_TYPES["object"]), F.lit(False))
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown tool"))
    for t in tools:
        checks = []
        for name, p in sorted(t.properties.items()):
            at = f"$['{name}']"
            value = F.try_variant_get(parsed, at, "variant")
            there = F.coalesce(F.schema_of_variant(value), F.lit("VOID")) != "VOID"
            wrong = ~F.schema_of_variant(value).rlike(_TYPES[p.kind])
            number = F.try_variant_get(parsed, at, "double")
            text = F.try_variant_get(parsed, at, "string")
            check = F.when(~there, F.lit(f"{name} is missing") if p.required else F.lit(None).cast("string"))
            check = check.when(wrong, F.lit(f"{name} is no {p.kind}"))
            if p.minimum is not None:
                check = check.when(number < p.minimum, F.lit(f"{name} is too small"))
            if p.maximum is not None:
                check = check.when(number > p.maximum, F.lit(f"{name} is too large"))
            if p.min_length is not None:
                check = check.when(F.length(text) < p.min_length, F.lit(f"{name} is too short"))
            checks.append(check)
        found = F.array_compact(F.array(*checks)) if checks else none
        out = F.when(tool == t.name, F.when(is_object, found).otherwise(F.array(F.lit("not an object")))).otherwise(out)
    return out


def _times(frame: DataFrame, n: str, block: int = 10_000) -> DataFrame:
    """Each row as often as its column n says, which is dropped."""
    blocks = frame.where(F.col(n) > 0).withColumn("at", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("bigint"), F.lit(block))))
    return blocks.withColumn("at", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col(n) - F.col("at"))))).drop("at", n)


def link(calls: DataFrame, results: DataFrame, repeats: bool = False) -> DataFrame:
    """Calls with their results, and results without a call (call columns null but for the keys).
    With repeats, results beyond the first of an identifier too, with the status `repeated result`.

    calls: conv_id, call_id, turn, tool, arguments (JSON text), cites (array of call identifiers);
    results: conv_id, call_id, turn, content. Adds result_turn, content, n_results, status.
    """
    keys = ["conv_id", "call_id"]
    linking = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = (
        results.where(linking)
        .groupBy(*keys)
        .agg(F.min(F.struct("content", "turn")).alias("r"), F.count(F.lit(1)).alias("n_results"))
        .select(*keys, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    )
    linked = calls.join(one.hint("shuffle_hash"), keys, "left").withColumn(
        "status", F.when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    )
    known = calls.select(*keys).distinct()
    orphans = one.join(known, keys, "left_anti").unionByName(
        results.where(~linking).select(
            *keys, F.col("turn").alias("result_turn"), "content", F.lit(1).cast("bigint").alias("n_results")
        )
    )
    linked = linked.unionByName(orphans.withColumn("status", F.lit("no call")), allowMissingColumns=True)
    if not repeats:
        return linked
    several = one.where("n_results > 1").select(
        *keys, F.struct("content", "result_turn").alias("first"), "n_results"
    )
    further = (
        results.withColumnRenamed("turn", "result_turn")
        .join(several, keys)
        .groupBy(*keys, "result_turn", "content", "first", "n_results")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n", F.col("n") - F.struct("content", "result_turn").eqNullSafe(F.col("first")).cast("int"))
        .select(*keys, "result_turn", "content", "n_results", F.lit("repeated result").alias("status"), "n")
    )
    return linked.unionByName(_times(further, "n"), allowMissingColumns=True)


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that cite others: 1 + the highest level of the calls cited; null in circles.

    Calls that cite none have level 0 and aren't listed. Each round settles the calls all of whose cited calls are
    settled, so there are as many rounds as the longest chain of citations. Where no call cites several, chains are
    followed by doubling steps instead, in as many rounds as the logarithm of the longest one.
    """
    keys = ["conv_id", "call_id"]
    known = calls.where(F.col("call_id").isNotNull()).select(*keys).distinct()
    edges = (
        calls.where(F.size("cites") > 0)
        .select("conv_id", "call_id", F.explode("cites").alias("cited"))
        .distinct()
        .join(known.withColumnRenamed("call_id", "cited"), ["conv_id", "cited"], "left_semi")
    )
    edges = stored(edges, "citations")
    if edges.groupBy(*keys).count().where("count > 1").isEmpty():
        return _chain_levels(edges)
    open_calls = edges.select(*keys).distinct()
    settled = edges.select("conv_id", F.col("cited").alias("call_id")).distinct().join(open_calls, keys, "left_anti")
    settled = stored(settled.withColumn("level", F.lit(0)), "levels")
    level = 0
    while True:
        level += 1
        state = settled.select("conv_id", F.col("call_id").alias("cited"), "level")
        ready = (
            edges.join(settled.select(*keys), keys, "left_anti")
            .join(state, ["conv_id", "cited"], "left")
            .groupBy(*keys)
            .agg(F.count(F.when(F.col("level").isNull(), 1)).alias("waiting"))
            .where(F.col("waiting") == 0)
            .select(*keys, F.lit(level).alias("level"))
        )
        ready = stored(ready, "levels")
        if ready.isEmpty():
            break
        settled = settled.unionByName(ready)
    return open_calls.join(settled, keys, "left").select(*keys, "level")


def _chain_levels(edges: DataFrame) -> DataFrame:
    """call_levels() of edges (conv_id, call_id, cited) with one cited call of each call.

    Every call knows the call `at` that is `level` steps down its chain (null at the chain's end), and each round puts
    that call's steps after its own. A round that finds no further end leaves circles alone: while chains go on, some
    end at each length.
    """
    keys = ["conv_id", "call_id"]
    citing = edges.select("conv_id", F.col("call_id").alias("cited"), F.lit(True).alias("cites_on"))
    steps = edges.join(citing, ["conv_id", "cited"], "left").select(
        *keys, F.when(F.col("cites_on"), F.col("cited")).alias("at"), F.lit(1).cast("bigint").alias("level")
    )
    steps = stored(steps, "steps")
    going = steps.where(F.col("at").isNotNull()).count()
    while going:
        on = steps.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("level").alias("more"))
        moved = steps.where(F.col("at").isNotNull()).join(on, ["conv_id", "at"])
        moved = moved.select(*keys, F.col("to").alias("at"), (F.col("level") + F.col("more")).alias("level"))
        steps = stored(moved.unionByName(steps.where(F.col("at").isNull())), "steps")
        left = steps.where(F.col("at").isNotNull()).count()
        if left == going:
            break
        going = left
    return steps.select(*keys, F.when(F.col("at").isNull(), F.col("level")).cast("int").alias("level"))


def records(
    messages: DataFrame,
    calls: DataFrame,
    results: DataFrame,
    tools: list[Tool],
    cited: bool = True,
    repeats: bool = False,
) -> DataFrame:
    """conv_id, level, turn, kind, call_id, status, faults, json: one canonical JSON line each.

    messages: conv_id, turn, role, text. Within a conversation (level, turn, kind, call_id) is a topological order.
    cited=False says that no call cites another, which spares finding levels. repeats=True returns every result, also
    those beyond the first of an identifier.
    """
    linked = link(calls, results, repeats)
    if cited:
        linked = linked.join(call_levels(calls).withColumn("cites_any", F.lit(True)), ["conv_id", "call_id"], "left")
        linked = linked.withColumn("level", F.when(F.col("cites_any"), F.col("level")).otherwise(F.lit(0)))
    else:
        linked = linked.withColumn("level", F.lit(0))
    is_call = F.col("status").isin("answered", "unanswered")
    status = F.when(is_call & F.col("level").isNull(), "circular").otherwise(F.col("status"))
    linked = linked.withColumns(
        {
            "kind": F.when(is_call, "call").otherwise("result"),
            "status": status,
            "faults": F.when(is_call, argument_faults(tools, F.col("tool"), F.col("arguments"))),
            "at_turn": F.coalesce(F.col("turn"), F.col("result_turn")),
        }
    )
    parsed = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))  # a variant's keys come sorted
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    call_json = F.concat(
        F.lit('{"arguments":'), parsed, F.lit(',"id":'), text("call_id"), F.lit(',"result":'), text("content"),
        F.lit(',"status":'), text("status"), F.lit(',"tool":'), text("tool"), F.lit(',"valid":'),
        F.when(F.size("faults") == 0, "true").otherwise("false"), F.lit("}"),
    )
    result_json = F.concat(
        F.lit('{"id":'), text("call_id"), F.lit(',"result":'), text("content"), F.lit(',"status":'), text("status"),
        F.lit("}"),
    )
    lines = linked.select(
        "conv_id", "level", F.col("at_turn").alias("turn"), "kind", "call_id", "status", "faults",
        F.when(is_call, call_json).otherwise(result_json).alias("json"),
    )
    plain = messages.select(
        "conv_id",
        F.lit(0).alias("level"),
        "turn",
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("array<string>").alias("faults"),
        F.concat(
            F.lit('{"content":'), text("text"), F.lit(',"role":'), text("role"), F.lit("}")
        ).alias("json"),
    )
    return lines.unionByName(plain)


def quoted(text: Column) -> Column:
    """The text as a JSON string; null for null."""
    wrapped = F.to_json(F.struct(text.alias("t")))  # {"t":...}
    return F.when(text.isNotNull(), F.substring(wrapped, 6, F.length(wrapped) - 6))


# ---- query ----

#: What a user's turn asks of the assistant, as a call.
REPLY = Tool(
    "reply", {"prompt": Property("string", True, min_length=1), "turn": Property("integer", True, minimum=0)}
)


def _cited_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, cited_turn of each user's turn: the last turn before it, in its conversation, with an answer."""
    role, turn = F.col("role"), F.col("turn")
    narrow = conversations.where(role.isin("user", "assistant") & F.col("conv_id").isNotNull() & turn.isNotNull())
    asked = narrow.select(
        "conv_id",
        F.when(role == "assistant", turn - 1).otherwise(turn).alias("turn"),
        (role == "user").alias("asks"),
    )
    turns = asked.groupBy("conv_id", "turn").agg(F.bool_or("asks").alias("asks"), (~F.bool_and("asks")).alias("answers"))
    answered = F.when(F.col("asks") & F.col("answers"), F.col("turn"))
    found = carry(turns, {"cited_turn": answered}, ["turn"], ["conv_id"], time="turn", segment=TURNS, before=True)
    return found.where("asks").select("conv_id", "turn", "cited_turn")


def as_calls(conversations: DataFrame, cited: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results of plain conversations: a user's turn calls `reply`, the assistant's turn after it
    is the result; both bear the identifier of the user's turn, null without conversation or turn. Other roles are
    plain messages. With cited, a call cites the last answered call before it in its conversation."""
    role = F.coalesce(F.col("role"), F.lit(""))
    turn_id = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    users = conversations.where(role == "user")
    cites = F.array().cast("array<string>")
    if cited:
        users = users.join(_cited_turns(conversations), ["conv_id", "turn"], "left")
        cites = F.array_compact(F.array(turn_id(F.col("cited_turn"))))
    calls = users.select(
        "conv_id",
        turn_id(F.col("turn")).alias("call_id"),
        "turn",
        F.lit(REPLY.name).alias("tool"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"))).alias("arguments"),
        cites.alias("cites"),
    )
    results = conversations.where(role == "assistant").select(
        "conv_id", turn_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return conversations.where(~role.isin("user", "assistant")), calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every conversation as canonical JSON, with its place and what its arguments lack: a call cites
    the answered call before it in its conversation and follows it, as results follow calls."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return _shown(records(*as_calls(table, cited=True), [REPLY], repeats=True))


def _shown(lines: DataFrame) -> DataFrame:
    return lines.select(
        "conv_id", "level", "turn", "kind", "call_id", "status", F.array_join("faults", "; ").alias("faults"), "json"
    )


ORACLE = """
with c as (
  select conv_id, conv_id::varchar || '-' || turn::varchar as call_id, turn, text
  from conversations where role = 'user'),
r as (
  select conv_id, conv_id::varchar || '-' || (turn - 1)::varchar as call_id, turn as result_turn, text as content,
    case when conv_id is null or turn is null then 1
      else row_number() over (partition by conv_id, turn order by text nulls first) end as nth
  from conversations where role = 'assistant'),
answered as (select distinct c.conv_id, c.turn from c join r using (conv_id, call_id)),
called as (
  select c.conv_id, call_id, c.turn, c.text, content,
    case when r.call_id is null then 'unanswered' else 'answered' end as status,
    nullif(concat_ws('; ', case when text is null then 'prompt is missing' when text = '' then 'prompt is too short' end,
      case when c.turn is null then 'turn is missing' when c.turn < 0 then 'turn is too small' end), '') as wrong,
    (select count(*) from answered a where a.conv_id = c.conv_id and a.turn < c.turn)::int as level
  from c left join (from r where nth = 1) r using (conv_id, call_id)),
loose as (
  select r.*, case when nth > 1 then 'repeated result' else 'no call' end as status,
    (select count(*) from answered a where a.conv_id = r.conv_id and a.turn < r.result_turn - 1
      and exists (from answered b where b.conv_id = r.conv_id and b.turn = r.result_turn - 1))::int as level
  from r where nth > 1 or not exists (from c where c.conv_id = r.conv_id and c.call_id = r.call_id))
select conv_id, level, turn, 'call' as kind, call_id, status, coalesce(wrong, '') as faults,
  '{"arguments":{' || case when text is null then '' else '"prompt":' || to_json(text) || case when turn is null
    then '' else ',' end end || coalesce('"turn":' || turn, '') || '},"id":' || coalesce(to_json(call_id), 'null')
    || ',"result":' || coalesce(to_json(content), 'null') || ',"status":"' || status || '","tool":"reply","valid":'
    || case when wrong is null then 'true' else 'false' end || '}' as json
from called
union all
select conv_id, level, result_turn, 'result', call_id, status, null,
  '{"id":' || coalesce(to_json(call_id), 'null') || ',"result":' || coalesce(to_json(content), 'null')
    || ',"status":"' || status || '"}'
from loose
union all
select conv_id, 0, turn, 'message', null, null, null,
  '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || '}'
from conversations where role is null or role not in ('user', 'assistant')
"""
