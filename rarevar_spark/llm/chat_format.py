"""Chat formatting: tool calls linked with their results, ordered, checked and written as canonical JSON.

Messages are rows, and stay rows: calls and results meet in a join on the conversation and the call's identifier, and the order
is a sort key for each message, so that a conversation of any length is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

ID = ["conv_id", "turn"]


def canonical_numbers(json: Column) -> Column:
    """JSON without blanks whose numbers have one form for each value: integers in full; others as the shortest digits that give the same double, without a trailing .0,
    and with an exponent only from 1e21 on and below 1e-6. Texts in quotes stay."""
    parts = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'), F.lit(0))
    plain = r"-?[0-9]+"

    def form(x: Column) -> Column:
        t = F.regexp_replace(x, "^-", "")
        point = F.regexp_extract(t, r"^([0-9]+)", 1)
        after = F.regexp_extract(t, r"^[0-9]+\.([0-9]+)", 1)
        power = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        digits = F.regexp_replace(F.concat(point, after), "^0+|0+$", "")
        # the value is 0.digits x 10^place
        place = power + F.length(point) - F.length(F.regexp_extract(F.concat(point, after), "^(0*)", 1))
        whole = F.when(place >= F.length(digits), F.rpad(digits, place, "0")).when(place > 0, F.concat(F.substring(digits, 1, place), F.lit("."), F.substring(digits, place + 1, F.length(digits))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place), digits)
        tail = F.substring(digits, F.lit(2), F.length(digits))
        power_form = F.concat(F.substring(digits, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.when(place > 0, "e+").otherwise("e"), (place - 1).cast("string"))
        number = F.when(digits == "", "0").when((place > 21) | (place < -5), power_form).when(place > 0, whole).otherwise(small)
        return F.when((digits == "") | ~x.startswith("-"), number).otherwise(F.concat(F.lit("-"), number))

    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^-?[0-9]") & (~x.rlike(f"^{plain}$") | (x == "-0")), form(x)).otherwise(x)), "")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no blanks and numbers of one form; null where ``text`` is no JSON."""
    return canonical_numbers(F.to_json(F.try_parse_json(text)))


def _type_fits(kind: str, wanted: str) -> str:
    return (
        f"case {wanted} when 'string' then {kind} = 'STRING' when 'integer' then {kind} = 'BIGINT' when 'boolean' then {kind} = 'BOOLEAN'"
        f" when 'number' then {kind} = 'BIGINT' or {kind} = 'DOUBLE' or {kind} like 'DECIMAL%'"
        f" when 'object' then {kind} like 'OBJECT%' when 'array' then {kind} like 'ARRAY%' else true end"
    )


def validate_arguments(calls: DataFrame, schemas: DataFrame, broadcast_tools: int = 10_000) -> DataFrame:
    """``calls`` (name, arguments) with ``problems``, an array of what is wrong with the arguments.

    ``schemas`` has one row for each parameter: tool, param, type (string, integer, number, boolean, object, array; others fit
    anything), required. Problems are 'unknown tool', 'not an object', 'missing p', 'type p' and 'unexpected p', sorted.
    Schemas are sent to all tasks while there are at most ``broadcast_tools`` tools, and joined by shuffling beyond.
    """
    spec = schemas.where("tool is not null").groupBy(F.col("tool").alias("tool_")).agg(F.collect_set(F.struct("param", "type", "required")).alias("spec_"))
    if spec.limit(broadcast_tools + 1).count() <= broadcast_tools:
        spec = F.broadcast(spec)
    joined = calls.join(spec, calls["name"] == spec["tool_"], "left").withColumn("args_", F.expr("try_parse_json(arguments)"))
    joined = joined.withColumn("map_", F.expr("case when schema_of_variant(args_) like 'OBJECT%' then from_json(arguments, 'map<string,variant>') end"))
    problems = F.expr(
        "case when spec_ is null then array('unknown tool') when map_ is null then array('not an object') else array_sort(concat("
        " transform(filter(spec_, p -> p.required and not map_contains_key(map_, p.param)), p -> concat('missing ', p.param)),"
        f" transform(filter(spec_, p -> map_contains_key(map_, p.param) and not ({_type_fits('schema_of_variant(map_[p.param])', 'p.type')})), p -> concat('type ', p.param)),"
        " transform(array_except(map_keys(map_), transform(spec_, p -> p.param)), k -> concat('unexpected ', k)))) end"
    )
    return joined.withColumn("problems", problems).drop("tool_", "spec_", "map_", "args_")


def order_keys(edges: DataFrame, together: int = 2000) -> DataFrame:
    """conv_id, turn, pos, level, cyclic of the messages that cannot stand at their own turn.

    ``edges`` (conv_id, turn, dep_turn): a message comes after another of its conversation. Messages are sorted by (pos, level, turn); pos
    is the latest turn among all that must come earlier and their own, and level the longest path to that one; messages that wait for each
    other in a circle, or for such, are cyclic and stay at their turns.

    Conversations in which nothing waits for a later message need no keys. Others are ordered as one small array each while at most ``together``
    messages wait in them, and longer ones in rounds of joins over their edges, as many as the longest chain.
    """
    edges = keep(edges.select("conv_id", "turn", "dep_turn").distinct(), "order-edges")
    size = edges.groupBy("conv_id").agg(F.count_distinct("turn").alias("size_"), F.max(F.col("dep_turn") >= F.col("turn")).alias("late_")).where("late_")
    edges = edges.join(size, "conv_id")
    out = _keys_in_arrays(edges.where(F.col("size_") <= together))
    if size.where(F.col("size_") > together).limit(1).count():
        out = out.unionByName(_keys_in_rounds(edges.where(F.col("size_") > together).select(*ID, "dep_turn")))
    return out


def _keys_in_arrays(edges: DataFrame) -> DataFrame:
    """Order keys by repeated maxima over each conversation's array of waiting messages, as often as it has messages or until nothing changes.

    First the latest turn that each must come after; then, along the edges that keep this turn, the longest path. It has no more steps than messages,
    so what grows beyond that hangs on a circle.
    """
    per = edges.groupBy(*ID).agg(F.sort_array(F.collect_list("dep_turn")).alias("deps")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "deps"))).alias("n"))
    turns = "transform(n, x -> x.turn)"
    per = per.withColumn("d", F.expr(f"transform(array({turns}), t -> transform(n, x -> transform(x.deps, y -> struct(y as turn, array_position(t, y) - 1 as at))))[0]"))
    rounds = "sequence(1, size(n) + 1)"
    settle = "aggregate({rounds}, struct({start} as v, false as done), (s, k) -> if(s.done, s, transform(array({step}), v -> struct(v, v = s.v as done))[0]), s -> s.v)"
    later = "transform(d, (deps, i) -> greatest(s.v[i], array_max(transform(deps, y -> if(y.at < 0, y.turn, s.v[y.at])))))"
    per = per.withColumn("pos", F.expr(settle.format(rounds=rounds, start=turns, step=later)))
    per = per.withColumn("tight", F.expr("transform(d, (deps, i) -> filter(deps, y -> if(y.at < 0, y.turn, pos[y.at]) = pos[i]))"))
    longer = "transform(tight, (deps, i) -> coalesce(array_max(transform(deps, y -> if(y.at < 0, 0, s.v[y.at]) + 1)), 0))"
    per = per.withColumn("level", F.expr(settle.format(rounds=rounds, start="transform(n, x -> 0)", step=longer)))
    per = per.select("conv_id", F.expr("size(n)").alias("most"), F.explode(F.arrays_zip(F.expr(turns).alias("turn"), "pos", "level")).alias("m")).select("conv_id", "m.turn", "m.pos", "m.level", "most")
    cyclic = F.col("level") > F.col("most")
    own = F.col("turn").cast("long")
    keys = per.select(*ID, F.when(cyclic, own).otherwise(F.col("pos")).alias("pos"), F.when(cyclic, 0).otherwise(F.col("level")).alias("level"), cyclic.alias("cyclic"))
    return keys.where("cyclic or pos != turn")


def _keys_in_rounds(edges: DataFrame) -> DataFrame:
    """Order keys by rounds of joins; only messages that move take part."""
    edges = keep(edges, "order-edges")
    no = F.lit(False)
    keys = edges.limit(0).select(*ID, F.lit(0).cast("long").alias("pos"), F.lit(0).alias("level"), no.alias("cyclic"), no.alias("new"))
    while True:
        moved, live = keys.where("not cyclic").select(*ID, "pos", "level"), edges.join(keys.where("cyclic").select(*ID), ID, "left_anti")
        dep = moved.select("conv_id", F.col("turn").alias("dep_turn"), F.col("pos").alias("dpos"), F.col("level").alias("dlevel"))
        k = live.join(dep, ["conv_id", "dep_turn"], "left").join(moved, ID, "left")
        k = k.select(*ID, F.coalesce("dpos", F.col("dep_turn").cast("long")).alias("dpos"), F.coalesce("dlevel", F.lit(0)).alias("dlevel"), F.coalesce("pos", F.col("turn").cast("long")).alias("pos"), F.coalesce("level", F.lit(0)).alias("level"))
        late = k.where("dpos > pos or (dpos = pos and dlevel >= level)")
        step = late.groupBy(*ID).agg(F.max(F.struct(F.col("dpos").alias("pos"), (F.col("dlevel") + 1).alias("level"))).alias("k")).select(*ID, "k.pos", "k.level", no.alias("cyclic"), F.lit(True).alias("new"))
        now = step.unionByName(keys.withColumn("new", no).join(step.select(*ID), ID, "left_anti"))
        # a chain has no more levels than its conversation has moved messages, and those of a circle keep within as many of each other
        crowd = now.where("not cyclic").groupBy("conv_id").agg(F.count(F.lit(1)).alias("crowd"), F.max("level").alias("top"))
        circle = F.coalesce((F.col("top") > 2 * F.col("crowd")) & (F.col("level") > F.col("crowd")), no)
        keys = keep(now.join(crowd, "conv_id", "left").select(*ID, "pos", "level", (F.col("cyclic") | circle).alias("cyclic"), "new"), "order-keys")
        if keys.where("new").limit(1).count() == 0:
            own = F.col("turn").cast("long")
            return keys.select(*ID, F.when(F.col("cyclic"), own).otherwise(F.col("pos")).alias("pos"), F.when(F.col("cyclic"), 0).otherwise(F.col("level")).alias("level"), "cyclic")


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message, with its place in the conversation, its link and its canonical JSON.

    ``messages``: conv_id, turn (a key), kind ('call', 'result' or anything else, taken as text), role, call_id, name, arguments (JSON
    text of a call), content, after (array of identifiers of calls that a call waits for). Returns conv_id, turn, kind, call_id,
    linked (a call with a result; a result with a call; null for text), problems (of a call's arguments, then 'no result', 'no call',
    'call_id used before', 'waits for unknown call', 'circle'), pos and level (sort by pos, level, turn) and json (keys sorted, nulls left out).
    Of calls that share an identifier the earliest has the results, all of them. Results stand after their calls and
    calls after what they wait for. Arguments that are no JSON stay as a text. Null identifiers link with nothing; rows that repeat a
    (conv_id, turn) are repeated, stand at one place and count as one message; an empty table gives no rows; other columns are ignored.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "kind", "role", "call_id", "name", "arguments", "content", "after")
    calls = m.where("kind = 'call' and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    answered = m.where("kind = 'result' and call_id is not null").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    known = keep(calls.join(answered, ["conv_id", "call_id"], "left"), "calls")
    waits = m.where("kind = 'call'").select("conv_id", "turn", F.explode("after").alias("call_id"))
    waits = waits.join(known.select("conv_id", "call_id", "call_turn"), ["conv_id", "call_id"], "left").where("call_turn is null or call_turn != turn")
    unknown = waits.where("call_turn is null").select(*ID).distinct().withColumn("lost", F.lit(True))
    to_call = m.where("kind = 'result'").select(*ID, "call_id").join(known, ["conv_id", "call_id"]).select(*ID, F.col("call_turn").alias("dep_turn"))
    keys = order_keys(waits.where("call_turn is not null").select(*ID, F.col("call_turn").alias("dep_turn")).unionByName(to_call))
    out = m.join(known, ["conv_id", "call_id"], "left").join(unknown, ID, "left").join(keys, ID, "left")
    out = validate_arguments(out, schemas)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own = is_call & (F.col("call_turn") == F.col("turn"))
    flag = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    problems = F.concat(
        F.when(is_call, F.col("problems")).otherwise(F.array().cast("array<string>")),
        flag(is_call & ~(own & F.coalesce("answered", F.lit(False))), "no result"), flag(is_result & F.col("call_turn").isNull(), "no call"),
        flag(is_call & (F.col("call_turn") < F.col("turn")), "call_id used before"), flag(is_call & F.coalesce("lost", F.lit(False)), "waits for unknown call"), flag(F.coalesce("cyclic", F.lit(False)), "circle"),
    )
    linked = F.when(is_call, F.coalesce(own & F.col("answered"), F.lit(False))).when(is_result, F.col("call_turn").isNotNull())
    json = canonical_numbers(F.expr(
        "to_json(named_struct('arguments', case when kind = 'call' then coalesce(try_parse_json(arguments), cast(arguments as variant)) end, 'call_id', call_id,"
        " 'content', case when kind = 'call' then null else content end, 'conv_id', conv_id, 'kind', kind, 'name', name, 'role', role, 'turn', turn))"
    ))
    return out.select(
        "conv_id", "turn", "kind", "call_id", linked.alias("linked"), problems.alias("problems"),
        F.coalesce("pos", "turn").alias("pos"), F.coalesce("level", F.lit(0)).alias("level"), json.alias("json"),
    )
