"""Tool calls of chats: linked to their results, put in a topological order, checked against schemas, written as canonical JSON.

Messages are (conv_id, turn, role, text). A call message's text is {"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}, a result
message's {"tool_call_id", "content"}. Calls and results are rows of their own and meet in a hash join on (conv_id, id), so no
conversation is gathered in a task for that. A call comes after those that it names; turns are the order, and only calls that name a later one
are moved behind it. Conversations in which one does are ordered at once, from their names alone, if they hold up to BOUNDED of them;
a larger one is ordered by rounds of joins over its moved calls.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, drop, ship, sliced, table

#: Names of other calls (some 100 bytes each) that a conversation may hold to be ordered in one task.
BOUNDED = 200_000

PARSED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("after", pa.list_(pa.string())), ("arguments", pa.string()), ("errors", pa.list_(pa.string())), ("content", pa.string())]
)
PARSED_DDL = "conv_id long, turn long, place long, kind string, call_id string, name string, after array<string>, arguments string, errors array<string>, content string"


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and shortest numbers; whole floats as integers; strings escaped only where JSON needs it."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return str(int(value)) if value == int(value) and abs(value) < 1e16 else repr(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


_TYPES = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "null": lambda v: v is None}


def check(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, minimum, maximum, minLength, maxLength, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    if kinds and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    bad = [f"{at}: enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        bad += [f"{at}: minimum"] if value < schema.get("minimum", value) else []
        bad += [f"{at}: maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        bad += [f"{at}: minLength"] if len(value) < schema.get("minLength", 0) else []
        bad += [f"{at}: maxLength"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        bad += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        bad += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known] if schema.get("additionalProperties") is False else []
        for k in sorted(known):
            if k in value:
                bad += check(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            bad += check(v, schema["items"], f"{at}[{i}]")
    return bad


def _plain(text: str):
    """The JSON object of a text, or None."""
    try:
        value = json.loads(text) if text.lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _text(value: str) -> str:
    """The string with every lone surrogate, which UTF-8 can't write, as U+FFFD."""
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _written(value, at: str) -> tuple[str | None, list[str]]:
    """Canonical JSON, or what keeps the value from having one."""
    try:
        made = canonical(value)
        made.encode()
    except UnicodeEncodeError:
        return None, [f"{at}: lone surrogate"]
    except ValueError:
        return None, [f"{at}: not a JSON number"]
    except RecursionError:
        return None, [f"{at}: nested too deeply"]
    return made, []


def _checked(args, name, schemas: dict) -> list[str]:
    if not isinstance(args, dict):
        return ["$: not an object"]
    if not isinstance(name, str) or name not in schemas:
        return ["unknown tool"]
    try:
        return [_text(e) for e in check(args, schemas[name])]
    except RecursionError:
        return ["$: nested too deeply"]


def _rows(conv_id, turn, value: dict, schemas: dict):
    calls = value.get("tool_calls")
    for place, call in enumerate(calls if isinstance(calls, list) else []):
        if not isinstance(call, dict) or not isinstance(call.get("id"), str):
            continue
        args, name, after = call.get("arguments"), call.get("name"), call.get("after")
        if isinstance(args, str):  # arguments may be JSON in a string
            args = _plain(args)
        written, errors = _written(args, "$") if isinstance(args, dict) else (None, [])
        after = sorted({_text(a) for a in after if isinstance(a, str)}) if isinstance(after, list) else []
        yield conv_id, turn, place, "call", _text(call["id"]), _text(name) if isinstance(name, str) else None, after, written, errors or _checked(args, name, schemas), None
    if isinstance(value.get("tool_call_id"), str):
        content, errors = value.get("content"), []
        if isinstance(content, str):
            content = _text(content)
        elif content is not None:
            content, errors = _written(content, "result")
        yield conv_id, turn, 0, "result", _text(value["tool_call_id"]), None, [], None, errors, content


def parse(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row a call and a row a result. Other messages, and texts that aren't such JSON (also where it is nested too deeply to be read), give
    none. Calls without an id are left out. What has no canonical JSON (a number that isn't finite, a lone surrogate in arguments, too
    deep a nesting) is an error of its row; lone surrogates in ids, names and contents become U+FFFD."""
    ship(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text")).where("conv_id is not null and text is not null and (text like '%tool_call%')")

    def run(batches):
        for b in sliced(batches, 1024):
            out = [row for conv_id, turn, text in zip(*(c.to_pylist() for c in b.columns)) for row in _rows(conv_id, turn, _plain(text) or {}, schemas)]
            if out:
                yield table(dict(zip(PARSED.names, zip(*out))), PARSED)

    return rows.mapInArrow(run, PARSED_DDL)


#: The level of a call on a cycle.
_ENDLESS = (1 << 31) - 1
PLACED = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("place", pa.int64()), ("level", pa.int32())])
PLACED_DDL = "conv_id long, call_id string, turn long, place long, level int"


def ordered(own: dict, named: dict) -> dict:
    """Places (turn, place, level) of calls: own has each call's (turn, place), named the calls that it names. One pass over the graph's
    strongly connected parts, which come out with those that they name before them."""
    at: dict = {}
    number: dict = {}
    low: dict = {}
    stack, on = [], set()
    for root in named:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        work = [(root, iter(named.get(root, ())))]
        while work:
            call, rest = work[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(named.get(b, ()))))
                    break
                if b in on:
                    low[call] = min(low[call], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[call])
                if low[call] == number[call]:
                    part = []
                    while not part or part[-1] != call:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    inside = set(part)
                    cyclic = len(part) > 1 or call in named.get(call, ())
                    best = max((*own[c], 0) for c in part)
                    for b in {b for c in part for b in named.get(c, ())} - inside:
                        best = max(best, (*at[b][:2], min(_ENDLESS, at[b][2] + 1)))
                    for c in part:
                        at[c] = (*best[:2], _ENDLESS) if cyclic else best
    return at


def _group(rows: pa.Table) -> pa.Table:
    own: dict = {}
    named: dict = {}
    for call, turn, place, before, before_turn, before_place in zip(*(rows.column(c).to_pylist() for c in ("call_id", "turn", "place", "before", "before_turn", "before_place"))):
        own[call], own[before] = (turn, place), (before_turn, before_place)
        named.setdefault(call, []).append(before)
    conv_id = rows.column("conv_id")[0].as_py()
    moved = [(conv_id, c, *p) for c, p in ordered(own, named).items() if p > (*own[c], 0)]
    return pa.Table.from_batches([table(dict(zip(PLACED.names, zip(*moved))) if moved else {n: [] for n in PLACED.names}, PLACED)])


def places(calls: DataFrame, bounded: int = BOUNDED) -> DataFrame:
    """conv_id, call_id, at (turn, place, level) of the calls that cannot stay at their own turn, as one that they name is later or is moved
    behind them; at is null for calls on a cycle and those that a cycle moves.

    A call's place is the largest of its own (turn, place, 0) and, for each call that it names, that one's place with a level more; on a
    cycle levels rise without end. Conversations without a call that names a later one (or itself) are left out at once. A null turn is
    taken as -1 here.
    """
    calls = calls.withColumn("turn", F.coalesce("turn", F.lit(-1)))
    edges = calls.select("conv_id", "call_id", "turn", "place", F.explode("after").alias("before"))
    edges = cut(edges.join(calls.select("conv_id", F.col("call_id").alias("before"), F.col("turn").alias("before_turn"), F.col("place").alias("before_place")), ["conv_id", "before"]), "edges")
    late = F.max((F.struct("before_turn", "before_place") >= F.struct("turn", "place")).cast("int"))
    per = cut(edges.groupBy("conv_id").agg(late.alias("late"), F.count("*").alias("n")).where("late = 1").select("conv_id", (F.col("n") <= bounded).alias("small")), "late")
    few = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = edges.join(F.broadcast(per) if few else per, "conv_id")
    placed = cut(some.where("small").drop("small").groupBy("conv_id").applyInArrow(_group, PLACED_DDL), "placed")
    if per.where("not small").limit(1).count():
        placed = placed.unionByName(_by_rounds(cut(some.where("not small").drop("small"), "large")))
    drop(edges)
    drop(per)
    return placed.select("conv_id", "call_id", F.when(F.col("level") < _ENDLESS, F.struct("turn", "place", "level")).alias("at"))


def _by_rounds(edges: DataFrame) -> DataFrame:
    """The same for conversations of any size, in as many rounds as calls in a row each name a later one. A level above the number of the
    conversation's moved calls gives a cycle away, and has no end from then on."""

    def behind(rows: DataFrame) -> DataFrame:
        level = F.when(F.col("at.level") < _ENDLESS, F.col("at.level") + 1).otherwise(_ENDLESS)
        next_ = F.struct(F.col("at.turn").alias("turn"), F.col("at.place").alias("place"), level.alias("level"))
        return rows.where(next_ > F.struct("turn", "place", F.lit(0).alias("level"))).groupBy("conv_id", "call_id").agg(F.max(next_).alias("at"))

    moved = fresh = cut(behind(edges.withColumn("at", F.struct(F.col("before_turn").alias("turn"), F.col("before_place").alias("place"), F.lit(0).alias("level")))), "moved")
    while fresh.limit(1).count():
        pushed = behind(edges.join(fresh.select("conv_id", F.col("call_id").alias("before"), "at"), ["conv_id", "before"]))
        before = moved.select("conv_id", "call_id", F.col("at").alias("old"))
        n = moved.groupBy("conv_id").agg(F.count("*").alias("n"))
        new = pushed.join(before, ["conv_id", "call_id"], "left").where("old is null or at > old").join(n, "conv_id", "left")
        ends = F.when(F.col("at.level") <= F.col("n") + 1, F.col("at.level")).otherwise(_ENDLESS)
        latest = cut(new.select("conv_id", "call_id", F.struct(F.col("at.turn").alias("turn"), F.col("at.place").alias("place"), ends.cast("int").alias("level")).alias("at")), "fresh")
        both = cut(moved.join(latest, ["conv_id", "call_id"], "left_anti").unionByName(latest), "moved")
        drop(moved)
        if fresh is not moved:
            drop(fresh)
        moved, fresh = both, latest
    return moved.select("conv_id", "call_id", "at.*")


def link(messages: DataFrame, schemas: dict[str, dict], bounded: int = BOUNDED) -> DataFrame:
    """A row a call, and a row a result without a call:

    conv_id, call_id, turn, place, name, after_turn, level (in the order of after_turn, level, turn, place a call follows those that it
    names; both are the turn and 0 unless a call had to move, and null where a cycle leaves no order), status (linked, no_result, no_call, early_result: the result's turn isn't after the call's), valid, errors,
    record (canonical JSON of id, name, arguments, result; null unless linked and valid).

    Of calls with the same id in a conversation the first (turn, place, then by text) counts, and likewise of results; conversations are told apart
    by conv_id; rows with a null conv_id or text are left out. Very long texts are parsed whole. A result that has no canonical JSON is an error
    too (its call isn't valid). Other columns of messages are not read; an empty table gives an empty one.
    """
    parsed = cut(parse(messages, schemas), "parsed")
    calls = parsed.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "name", "after", "arguments", "errors")).alias("c")).select("conv_id", "call_id", "c.*")
    results = parsed.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content", "errors")).alias("r")).select("conv_id", "call_id", "r")
    calls = cut(calls, "calls")
    moved = places(calls, bounded).select("conv_id", "call_id", "at", F.lit(True).alias("moved"))
    both = calls.join(results, ["conv_id", "call_id"], "full_outer").join(moved, ["conv_id", "call_id"], "left")
    has_call, has_result = F.col("errors").isNotNull(), F.col("r").isNotNull()
    status = F.when(~has_call, "no_call").when(~has_result, "no_result").when(F.col("r.turn") <= F.col("turn"), "early_result").otherwise("linked")
    errors = F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.coalesce("r.errors", F.array().cast("array<string>")))
    row = both.select(
        "conv_id",
        "call_id",
        F.coalesce("turn", "r.turn").alias("turn"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"),
        "name",
        F.when(F.col("moved"), F.col("at.turn")).otherwise(F.coalesce("turn", "r.turn")).alias("after_turn"),
        F.when(F.col("moved"), F.col("at.level")).otherwise(F.lit(0)).alias("level"),
        status.alias("status"),
        (has_call & (F.size(errors) == 0)).alias("valid"),
        errors.alias("errors"),
        "arguments",
        F.col("r.content").alias("content"),
    )
    return _records(row)


LINKED = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("place", pa.int64()), ("name", pa.string()), ("after_turn", pa.int64()), ("level", pa.int32()), ("status", pa.string()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("record", pa.string())])
LINKED_DDL = "conv_id long, call_id string, turn long, place long, name string, after_turn long, level int, status string, valid boolean, errors array<string>, record string"


def _records(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches, 1024):
            c = {n: b.column(n) for n in b.schema.names}
            record = [
                "{" + f'"arguments":{args},"id":{canonical(i)},"name":{canonical(name)},"result":{canonical(content)}' + "}" if status == "linked" and valid else None
                for i, name, args, content, status, valid in zip(*(c[n].to_pylist() for n in ("call_id", "name", "arguments", "content", "status", "valid")))
            ]
            yield table({**{n: c[n] for n in LINKED.names[:-1]}, "record": record}, LINKED)

    return rows.mapInArrow(run, LINKED_DDL)
