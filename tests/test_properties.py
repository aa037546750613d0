"""Properties over random input."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snipscan.functions import labels
from snipscan.functions import text as fn
from snipscan.sources.shell import classify_argv, extract
from snipscan.sources.walker import facts

PIECES = ["python3", " ", "-c", "'", '"', "\\", "\n", "<<E", "E", "|", "&&", ";", "(", ")", "$(", "`", "cat", "x.py", "<", ">", "cd d", "bash -c", "# no", "é", "\t", "uv run", "A=1"]
CODE = ["import os\n", "os.", "remove", "(", ")", "'x'", "\n", "    ", "def f(a, *b):", "if x:", "else:", "[", "]", "for i in y:", " = ", "lambda q: q", "with open(p) as g:", "f'{x}'", "class C:", "try:", "except E as e:", "match z:", "case 1:", "await ", "é", "@d\n", "return", ":=", "\0", "del ", "global v"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_any_command_is_read(command):
    for source, label, file in extract(command):
        assert isinstance(label, str) and (source is None) == (file is not None)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(CODE), max_size=30).map("".join)))
def test_any_source_is_walked(source):
    got = facts(source)
    c = got["counters"]
    assert c["lines_total"] == c["lines_code"] + c["lines_comment"] + c["lines_blank"]
    assert [n[0] for n in got["nodes"]] == list(range(len(got["nodes"])))
    assert all(n[1] < n[0] for n in got["nodes"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["-c", "-m", "-", "--", "-W", "-uBc", "x", "s.py", "-3.12", "--version", "-Xdev", "-h"]), max_size=6))
def test_argv_runs_one_thing(args):
    run = classify_argv(args)
    assert sum([run.code is not None, run.module is not None, run.script is not None, run.stdin]) <= 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.integers(0, 50))
def test_clip_is_short_and_stable(text, size):
    cut = labels.clip(text, size)
    assert len(cut) <= max(size, 0) and labels.clip(cut, size) == cut and (len(text) > size or cut == text)


def test_columns_agree_with_python(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab ,([)x.\t\né") for _ in range(rng.randrange(60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: (r.c, r.q) for r in df.select("i", fn.clip(F.col("s"), 28).alias("c"), fn.squeeze(F.col("s")).alias("q")).collect()}
    assert got == {i: (labels.clip(s, 28), labels.squeeze(s)) for i, s in rows}
