import random

from pyspark.sql import functions as F

from eventlens.llm.chat import CONTROL, fold_events, read_back, render

EVENTS = "conv bigint, seq bigint, msg string, kind string, role string, text string, formatted string"


def back(spark, rows):
    events = spark.createDataFrame([(*r, "?") for r in rows], EVENTS)
    got = read_back(render(fold_events(events))).collect()
    return {r.conv: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in got}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "q", "message", "user", "helo"), (1, 5, "q", "edit", None, "hello"),
        (1, 2, "a", "delta", "assistant", "Hi"), (1, 3, "a", "delta", None, " you"),
        (1, 6, "a", "regenerate", None, "dropped"), (1, 7, "a", "delta", None, "Good"), (1, 8, "a", "delta", None, " day"),
        (2, 1, "x", "regenerate", "assistant", None), (2, 0, None, "message", "user", "alone"),
        (3, 1, "x", "delta", None, "no role"), (3, 1, "x", "delta", None, None),
    ]
    random.Random(0).shuffle(rows)
    assert back(spark, rows) == {
        1: ([("user", "hello"), ("assistant", "Good day")], "Good day"),
        2: ([("user", "alone"), ("assistant", "")], ""),
        3: ([("", "no role")], ""),
    }


def test_round_trip_of_control_strings(spark):
    rng = random.Random(7)
    pieces = [*CONTROL, "\\", "\\\\", "\n", "<", "<|", "|>", "[", "]", "a", "é", "\U0001f600", "INST]", "/", "", "turn|>"]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    rows, want = [], {}
    for conv in range(150):
        turns = [(rng.choice(["assistant", "user", text()]), text()) for _ in range(rng.randint(1, 6))]
        rows += [(conv, i, None, "message", role, body) for i, (role, body) in enumerate(turns)]
        want[conv] = (turns, "".join(body for role, body in turns if role == "assistant"))
    assert back(spark, rows) == want


def test_controls_never_occur_in_escaped_texts(spark):
    rows = [(i, 0, None, "message", "user", c + c) for i, c in enumerate(CONTROL)]
    made = render(fold_events(spark.createDataFrame([(*r, "?") for r in rows], EVENTS)))
    for r in made.collect():
        inner = r.formatted[len("<|turn|>") : -len("<|end|>")]
        assert not any(c in inner for c in CONTROL)


def test_nulls_ties_repeats_and_long(spark):
    rows = [
        (None, None, None, "message", None, None), (1, 0, None, "message", "user", "b"), (1, 0, None, "message", "user", "a"),
        (1, 0, None, "message", "user", "a"), *((9, i, None, "message", "assistant", "word " * 50) for i in range(1500)),
    ]
    got = back(spark, rows)
    assert got[None] == ([("", "")], "")
    assert got[1] == ([("user", "a"), ("user", "a"), ("user", "b")], "")
    assert got[9][1] == "word " * 50 * 1500
    assert render(fold_events(spark.createDataFrame([], EVENTS))).count() == 0


def test_mask_points_at_bodies(spark):
    rows = [(1, 0, None, "message", "user", "\U0001f600 q"), (1, 1, None, "message", "assistant", "a\U0001f600</s>")]
    r = render(fold_events(spark.createDataFrame([(*x, "?") for x in rows], EVENTS))).select("formatted", F.col("loss")[0].alias("s")).first()
    assert r.formatted[r.s.start : r.s.start + r.s.length] == "a\U0001f600<\\/s>"
