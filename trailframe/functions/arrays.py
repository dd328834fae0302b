"""Token arrays: padding, masks, packed sequences, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_right(a: Column, size: Column | int, by: Column) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(a, F.array_repeat(by, F.greatest(F.lit(0), n - F.size(a))))


def pad_left(a: Column, size: Column | int, by: Column) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.array_repeat(by, F.greatest(F.lit(0), n - F.size(a))), a)


def carry_forward(a: Column, size: Column) -> Column:
    """Padded to a size with the array's own last value."""
    return F.when(F.size(a) > 0, pad_right(a, size, F.element_at(a, -1))).otherwise(a)


def response_mask(ids: Column, end: int) -> Column:
    """1 up to and with the first end id, then 0."""
    at = F.array_position(ids, F.lit(end))
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def packed_lengths(mask: Column) -> Column:
    """Lengths of the sequences numbered 1, 2, ... in a packed mask; 0 is padding."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(mask))), lambda k: F.size(F.filter(mask, lambda x: x == k)))


def cumulative_lengths(lengths: Column) -> Column:
    """0 and the running sums."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def length_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """Non-positive penalty that grows once the length comes within the buffer of the limit."""
    return F.least((F.lit(float(most - buffer)) - length) / buffer * factor, F.lit(0.0))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns from right to left that start anew where the mask is 0."""
    pairs = F.reverse(F.zip_with(rewards, mask, lambda r, m: F.struct(r.alias("r"), m.alias("m"))))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        run = p["r"].cast("double") + gamma * a["run"]
        return F.struct((run * p["m"]).alias("run"), F.concat(F.array(run), a["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages by a backward fold; masked tokens are passed over and carry the advantage after them."""
    triples = F.reverse(F.transform(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")), lambda x: x))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("v"), zero.alias("a"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        on = x["m"] > 0
        delta = x["r"].cast("double") + gamma * s["v"] - x["v"]
        adv = delta + gamma * lam * s["a"]
        return F.struct(F.when(on, x["v"].cast("double")).otherwise(s["v"]).alias("v"), F.when(on, adv).otherwise(s["a"]).alias("a"), F.concat(F.array(F.when(on, adv).otherwise(s["a"])), s["out"]).alias("out"))

    return F.aggregate(triples, start, step, lambda s: s["out"])
