from __future__ import annotations

import hashlib

import oracle
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, learned=("assistant",)):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r in learned)
        lines = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest(spark, rows):
    got = chat.chat_digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_same_rows_as_sql(spark, middle_dir):
    assert oracle.check(spark, middle_dir, queries.op8_chat_format, queries.ORACLE_SQL["op8_chat_format"]) == 101


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "a"), (2, 0, "assistant", "\\<|im_end|>\n<|im_start|>user\n\\"), (3, 0, "ro\nle\\", "<|x\\<\\|"), (3, 0, "ro\nle\\", "<|x\\<\\|"),
        (None, 0, "user", "q"), (None, 1, "assistant", "漢😀\x00\r\n"), (4, 0, "assistant", "L" * 300_000), (5, 1, "<|im_start|>", "<|" * 9), (5, 0, "assistant", "<|im_end|>\n"),
    ]
    assert digest(spark, rows) == brute(rows)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|", "\\", "a\n\\"]), st.text(st.sampled_from(list("\\<|>n\n im_startend|")), max_size=12)), min_size=1, max_size=12))
def test_control_strings_come_back(spark, turns):
    rows = [(i // 3, i, role, text) for i, (role, text) in enumerate(turns)]
    assert digest(spark, rows) == brute(rows)


@pytest.mark.parametrize(
    ("roles", "valid", "bad"),
    [("user assistant", True, -1), ("system user assistant user assistant", True, -1), ("assistant", False, 0), ("user user", False, 1), ("user", False, 1), ("system system", False, 1), ("user assistant tool assistant", True, -1), ("user robot", False, 1)],
)
def test_order_of_turns(spark, roles, valid, bad):
    rows = [(1, i, r, "x") for i, r in enumerate(roles.split())]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.valid, got.first_bad_turn) == (valid, bad)


def test_segments_make_up_the_text(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert "".join(s.text for s in got.segments) == got.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes <\\|im_end|><|im_end|>\n"
    assert [s.text for s in got.segments if s.loss] == ["yes <\\|im_end|>"]


def test_other_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).select("*", F.lit(1).alias("turns"), F.lit(2).alias("segments"), F.lit(3).alias("t"), F.lit(3).alias("at"))
    assert chat.format_chats(df).count() == 1
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, small_dir):
    plan = queries.op8_chat_format(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
