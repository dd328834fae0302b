"""Parsing of logged conversations and actions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.registry import Registry

#: Markers, patterns and the action vocabulary of the log format.
END_OF_TEXT = "<|endoftext|>"
MESSAGE = r"(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>"
NUMBER = r"([\d.e+-]+)"
POSE = r"\[tx=" + NUMBER + r",\s*ty=" + NUMBER + r",\s*tz=" + NUMBER + r",\s*rx=" + NUMBER + r"°?,\s*ry=" + NUMBER + r"°?,\s*rz=" + NUMBER + r"°?\]"
SCENE = r"scene(\d+_\d+)"
ACTION = r"(?s)<action>(.*?)</action>"
ANSWER_CALL = r"(?i)^answer\s*\("
GRID_FIRST = r"(?s)\[Initial Observation\]:\s*\n(.*?)\nDecide your next action"
GRID_AFTER = r"(?s)After that, the observation is:\s*\n(.*?)\nDecide your next action"
ACTIONS = [
    "move_forward", "move_backward", "move_left", "move_right", "move_up", "move_down",
    "turn_left", "turn_right", "look_up", "look_down", "rotate_cw", "rotate_ccw",
]

formats = Registry("response format")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chatml_messages(text: Column) -> Column:
    """Messages of a ChatML text: array of (role, content), contents stripped."""
    clean = F.replace(text, F.lit(END_OF_TEXT), F.lit(""))
    roles = F.regexp_extract_all(clean, F.lit(MESSAGE), F.lit(1))
    contents = F.regexp_extract_all(clean, F.lit(MESSAGE), F.lit(2))
    return F.zip_with(roles, contents, lambda r, c: F.struct(r.alias("role"), strip(c).alias("content")))


def chatml_text(messages: Column) -> Column:
    """The ChatML text of an array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")


def pose(text: Column) -> Column:
    """The first six-number pose of a text, or null."""
    parts = [F.regexp_extract(text, POSE, i + 1).try_cast("double").alias(n) for i, n in enumerate(("tx", "ty", "tz", "rx", "ry", "rz"))]
    return F.when(text.rlike(POSE), F.struct(*parts))


def scene(text: Column) -> Column:
    return F.coalesce(null_if_empty(F.regexp_extract(text, SCENE, 1)), F.lit("unknown"))


def action(text: Column) -> Column:
    """Body of the first action tag; null for none and for a final answer."""
    body = strip(F.regexp_extract(text, ACTION, 1))
    return F.when(text.rlike(ACTION) & ~body.rlike(ANSWER_CALL), body)


def tokens(text: Column, sep: str = "|") -> Column:
    return F.filter(F.transform(F.split(text, "\\" + sep), lambda x: strip(x)), lambda x: x != "")


def clean_action(text: Column) -> Column:
    """Known actions only, in lower case, joined by ` | `; null if none is left."""
    known = F.filter(F.transform(F.split(text, r"\|"), lambda x: F.lower(strip(x))), lambda x: x.isin(ACTIONS))
    return null_if_empty(F.array_join(known, " | "))


def action_count(text: Column) -> Column:
    return F.size(tokens(text))


def text_grid(text: Column, first: bool) -> Column:
    """Text grid of an observation, lines stripped on the right."""
    pattern = GRID_FIRST if first else GRID_AFTER
    return F.when(text.rlike(pattern), F.regexp_replace(strip(F.regexp_extract(text, pattern, 1)), r"(?m)[ \t]+$", ""))


def _format(text: Column, pattern: str, think: int | None, blob: int) -> Column:
    empty = F.lit("")
    found = text.rlike(pattern)
    part = lambda g: empty if g is None else F.when(found, strip(F.regexp_extract(text, pattern, g))).otherwise(empty)
    return F.struct(found.alias("ok"), part(think).alias("think"), part(blob).alias("actions"))


@formats.register("free_think")
def strict_think(text: Column) -> Column:
    """The whole response is one think part and one action part."""
    return _format(text, r"(?s)^\s*<think>(.*?)</think>\s*<action>(.*?)</action>\s*$", 1, 2)


@formats.register("eval_mode")
def lenient(text: Column) -> Column:
    """An action part anywhere, with a think part before it or not."""
    found = _format(text, r"(?s)<action>(.*?)</action>", None, 1)
    return F.struct(found["ok"].alias("ok"), strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)).alias("think"), found["actions"].alias("actions"))


@formats.register("no_think")
def action_only(text: Column) -> Column:
    return _format(text, r"(?s)^\s*<action>(.*?)</action>\s*$", None, 1)


_CALL = r"^([A-Za-z_]\w*)(?:\(([^()]*)\))?$"


def action_list(text: Column) -> Column:
    """`name` or `name(arg)` separated by bars: (ok, actions); one bad token spoils all."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), r"\|"), lambda x: x != "")
    ok = F.forall(parts, lambda x: x.rlike(_CALL))
    one = lambda x: F.struct(F.lower(F.regexp_extract(x, _CALL, 1)).alias("name"), F.when(x.endswith(")"), F.regexp_extract(x, _CALL, 2)).alias("arg"))
    return F.struct(ok.alias("ok"), F.when(ok, F.transform(parts, one)).otherwise(F.array().cast("array<struct<name:string,arg:string>>")).alias("actions"))


def mcq_options(text: Column, pattern: str = r"(?m)^\s*([A-Z])\.\s*([^\n]+)$") -> Column:
    """Options `A. text` as a map of letters; empty with fewer than two. A repeated letter keeps its last text."""
    letters, texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(letters, texts, lambda a, b: F.struct(a.alias("key"), F.rtrim(F.regexp_replace(b, r"[.,;:\s]+$", "")).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.when(F.size(F.array_distinct(letters)) >= 2, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def reward(score: Column, scores_json: Column) -> Column:
    """`score` where present, else the sum of a scalar, object or array of numbers in JSON, else 0."""
    numbers = F.regexp_extract_all(F.regexp_replace(scores_json, r'"[^"]*"\s*:', ""), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    total = F.aggregate(F.transform(numbers, lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(score, total, F.lit(0.0))


def tri_state(flag: Column) -> Column:
    return F.when(flag.isNull(), "missing").when(flag, "true").otherwise("false")


def first_of(*keys: Column) -> Column:
    """The first key that is present (success flags and other fields with fallbacks)."""
    return F.coalesce(*keys)


def cut_text(text: Column, size: int = 100) -> Column:
    return F.substring(text, 1, size)


def masked(text: Column, pattern: str, by: str = "*") -> Column:
    return F.regexp_replace(text, pattern, by)


def answer_tag(text: Column) -> Column:
    """Body of the last answer tag, or null."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


def tagged_segments(text: Column) -> Column:
    """Alternating segments of code, interpreter and answer tags as (tag, body)."""
    pattern = r"(?s)<(code|interpreter|answer)>(.*?)</(?:code|interpreter|answer)>"
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: F.struct(a.alias("tag"), b.alias("body")))
