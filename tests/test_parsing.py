"""Parsing, text and geometry on hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from trailframe.functions import arrays, geometry, parse, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_chatml(spark):
    s = "<|im_start|>user\n hi\nthere <|im_end|>\n<|im_start|>assistant\nyo<|im_end|><|endoftext|>"
    got = one(spark, parse.chatml_messages(F.col("s")), s=s)
    assert [tuple(m) for m in got] == [("user", "hi\nthere"), ("assistant", "yo")]
    assert one(spark, parse.chatml_text(parse.chatml_messages(F.col("s"))), s=s).count("<|im_start|>") == 2


@pytest.mark.parametrize(("s", "want"), [("Turn_Left | fly |move_forward|", "turn_left | move_forward"), ("fly", None), ("", None)])
def test_clean_action(spark, s, want):
    assert one(spark, parse.clean_action(F.col("s")), s=s) == want


def test_pose_scene_action(spark):
    assert tuple(one(spark, parse.pose(F.col("s")), s="at [tx=1.5, ty=-2, tz=1e1, rx=0°, ry=90.0°, rz=3] ok")) == (1.5, -2.0, 10.0, 0.0, 90.0, 3.0)
    assert one(spark, parse.pose(F.col("s")), s="[tx=1]") is None
    assert one(spark, parse.scene(F.col("s")), s="in scene0001_02 and scene3_4") == "0001_02"
    assert one(spark, parse.scene(F.col("s")), s="none") == "unknown"
    assert one(spark, parse.action(F.col("s")), s="<action> a | b </action>") == "a | b"
    assert one(spark, parse.action(F.col("s")), s="<action>Answer (1)</action>") is None
    assert one(spark, parse.action_count(F.col("s")), s="a| |b|") == 2


def test_grid(spark):
    s = "[Initial Observation]: \n##  \n#_ \nDecide your next action"
    assert one(spark, parse.text_grid(F.col("s"), True), s=s) == "##\n#_"
    assert one(spark, parse.text_grid(F.col("s"), False), s=s) is None


def test_formats(spark):
    full = "<think>t</think> <action>go</action>"
    assert tuple(one(spark, parse.formats.get("free_think")(F.col("s")), s=full)) == (True, "t", "go")
    assert one(spark, parse.formats.get("free_think")(F.col("s")), s="x" + full)["ok"] is False
    assert tuple(one(spark, parse.formats.get("eval_mode")(F.col("s")), s="x" + full)) == (True, "t", "go")
    assert one(spark, parse.formats.get("no_think")(F.col("s")), s=full)["ok"] is False
    with pytest.raises(ValueError, match="unknown"):
        parse.formats.get("other")
    with pytest.raises(ValueError, match="already"):
        parse.formats.register("no_think")(lambda c: c)


def test_action_list(spark):
    got = one(spark, parse.action_list(F.col("s")), s="Go|turn( left )|")
    assert got["ok"] and [tuple(a) for a in got["actions"]] == [("go", None), ("turn", "left")]
    assert tuple(one(spark, parse.action_list(F.col("s")), s="go|a b(")) == (False, [])


def test_options_and_rewards(spark):
    assert one(spark, parse.mcq_options(F.col("s")), s="Q\nA. one.\nB. two;\nB. three") == {"A": "one", "B": "three"}
    assert one(spark, parse.mcq_options(F.col("s")), s="A. only") == {}
    none = F.lit(None).cast("double")
    assert one(spark, parse.reward(none, F.col("s")), s='{"a1": 1, "b": 0.5}') == 1.5
    assert one(spark, parse.reward(none, F.lit(None).cast("string"))) == 0.0
    assert one(spark, parse.reward(F.lit(0.25), F.col("s")), s="[1]") == 0.25


def test_answers(spark):
    assert one(spark, text.normalize_answer(F.col("s")), s="The  Cat, a dog!") == "cat dog"
    assert one(spark, text.exact_match(F.col("s"), F.array(F.lit("x"), F.lit("the CAT"))), s="A cat.") == 1
    assert one(spark, text.sub_match(F.col("s"), F.array(F.lit("cat"))), s="my cat sat") == 1
    assert one(spark, parse.answer_tag(F.col("s")), s="<answer>a</answer><answer> b </answer>") == "b"
    assert one(spark, text.final_number(F.col("s")), s="so #### 1,234.") == "1234"
    assert one(spark, text.final_number(F.col("s"), strict=False), s="is 7, then 8") == "8"
    assert one(spark, text.final_number(F.col("s")), s="no") is None
    assert one(spark, text.boxed_answer(F.col("s")), s=r"so \boxed{1} and \boxed{\frac{1}{2}}.") == r"\frac{1}{2}"
    assert one(spark, text.boxed_answer(F.col("s")), s=r"\boxed{1") is None
    assert one(spark, text.number_key(F.lit(-0.5))) == "neg0p5"
    with pytest.raises(Exception, match="no score"):
        one(spark, text.dispatch_score(F.col("s"), {"a": F.lit(1.0)}), s="b")


def test_overlap_scores(spark):
    same = one(spark, text.text_overlap(F.col("a"), F.col("b")), a="a b c d e", b="a b c d e")
    assert same["rouge1"] == same["rouge2"] == same["rougel"] == 100.0 and round(same["bleu4"], 4) == 100.0
    assert tuple(one(spark, text.text_overlap(F.col("a"), F.col("b")), a="", b="x")) == (0.0,) * 4
    assert one(spark, text.text_overlap(F.col("a"), F.col("b")), a="a x c", b="a c")["rougel"] == 80.0


@pytest.mark.parametrize(("deg", "want"), [(0.0, 0), (22.5, 1), (350.0, 0), (-90.0, 6)])
def test_cardinal(spark, deg, want):
    assert one(spark, geometry.cardinal(F.lit(deg))) == want


@pytest.mark.parametrize(("n", "want"), [(0, "[0,2]"), (2, "[0,2]"), (3, "[3,5]"), (8, "[6,8]"), (9, "[9,+inf]")])
def test_intervals(spark, n, want):
    assert one(spark, geometry.interval_label(F.lit(n), [2, 5, 8])) == want


def test_rotations(spark):
    m = geometry.rotation(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    assert [round(one(spark, a), 6) for a in geometry.euler(m)] == [10.0, 20.0, 30.0]
    zero = F.lit(0.0)
    assert round(one(spark, geometry.geodesic(m, m)), 3) == 0.0
    assert round(one(spark, geometry.geodesic(geometry.rotation(zero, zero, F.lit(90.0)), geometry.rotation(zero, zero, zero))), 6) == 90.0
    inv, t = geometry.invert(geometry.rotation(zero, zero, F.lit(90.0)), [F.lit(1.0), zero, zero])
    assert round(one(spark, t[1]), 6) == 1.0 and round(one(spark, inv[0][1]), 6) == 1.0
    assert one(spark, geometry.wrap_degrees(F.lit(180.0))) == -180.0
    assert one(spark, geometry.closeness(F.lit(100.0), 0.0, 1.0)) == 0.0


def test_moves_and_views(spark):
    p = one(spark, geometry.camera_moves(F.array(*map(F.lit, ["move_forward", "turn_left", "turn_left", "turn_left", "move_forward"]))))
    assert (round(p["x"], 6), round(p["y"], 6), p["heading"]) == (0.5, 0.5, 90.0)
    v = geometry.projected(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0), 100.0, 64, 64)
    assert one(spark, v["u"]) == 32.0 and one(spark, v["visible"]) is False
    assert one(spark, geometry.grid_cell(F.lit(99.0), F.lit(-1.0), 1.0, 4, 4)) == 3
    r = geometry.overlap_ratios(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4)))
    assert [one(spark, r[k]) for k in ("in_first", "in_second", "iou")] == [0.5, 1 / 3, 0.25]


def lits(*xs):
    return F.array(*map(F.lit, xs))


def test_arrays(spark):
    assert one(spark, arrays.pad_right(lits(1, 2), 4, F.lit(0))) == [1, 2, 0, 0]
    assert one(spark, arrays.pad_left(lits(1, 2), 4, F.lit(0))) == [0, 0, 1, 2]
    assert one(spark, arrays.carry_forward(lits(1, 2), F.lit(4))) == [1, 2, 2, 2]
    assert one(spark, arrays.response_mask(lits(5, 2, 7), 2)) == [1, 1, 0]
    assert one(spark, arrays.response_mask(lits(5, 7), 2)) == [1, 1]
    assert one(spark, arrays.packed_lengths(lits(1, 1, 2, 2, 2, 0))) == [2, 3]
    assert one(spark, arrays.cumulative_lengths(lits(2, 3))) == [0, 2, 5]
    assert one(spark, arrays.length_penalty(F.lit(16000), 20000, 5000, 1.0)) == -0.2
    assert one(spark, arrays.length_penalty(F.lit(1), 20000, 5000, 1.0)) == 0.0


def test_discounted_returns(spark):
    got = one(spark, arrays.discounted_returns(lits(1.0, 2.0, 4.0), lits(1, 1, 1), 0.5))
    assert got == [3.0, 4.0, 4.0]


def test_gae_passes_over_masked_tokens(spark):
    r, m = lits(1.0, 0.0, 2.0), lits(1, 0, 1)
    a = one(spark, arrays.gae(r, lits(0.5, 9.0, 1.0), m, 0.9, 0.8))
    b = one(spark, arrays.gae(r, lits(0.5, -7.0, 1.0), m, 0.9, 0.8))
    last = 2.0 - 1.0
    assert a == b and math.isclose(a[2], last) and math.isclose(a[0], 1.0 + 0.9 * 1.0 - 0.5 + 0.72 * last)
