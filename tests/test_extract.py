"""Commands and payloads to snippets."""

from __future__ import annotations

import json

import pytest

from snipscan.sources import extract as x
from snipscan.sources.shell import classify_argv, extract

CASES = [
    ("python3 - <<'PY'\nimport this\nPY\n", [("import this\n", "heredoc <<PY")]),
    ("python3.12 <<-STOP\n\t\tn = 4\n\tSTOP\n", [("n = 4\n", "heredoc <<STOP")]),
    ("pypy3 <<Q\nn = 5\n", [("n = 5\n", "heredoc <<Q (unterminated)")]),
    ("python <<ONE; python <<'TWO'\n1\nONE\n2\nTWO\n", [("1\n", "heredoc <<ONE"), ("2\n", "heredoc <<TWO")]),
    ("cat - <<T | sudo python\nk = 9\nT\n", [("k = 9\n", "heredoc <<T")]),
    ("ipython <<< 'len([])'", [("len([])\n", "here-string <<<")]),
    ("python -c \"m = 8 >> 1\"", [("m = 8 >> 1", "python -c")]),
    ("python3 -OOsc 'm()'", [("m()", "python -c")]),
    ("LANG=C doas -u web nohup timeout -k 1 9 nice -n 5 python3 -c go", [("go", "python -c")]),
    ("uv run --python 3.12 --with rich python -c go", [("go", "python -c")]),
    ("zsh -ic \"cd /srv; python3 -c 'go'\"", [("go", "python -c")]),
    ("echo -e 'go()' | pypy", [("go()\n", "<pipe> echo")]),
    ("printf 'a\\nb' | python3", [("a\nb", "<pipe> printf")]),
    ("ssh host job | python3 -", [("", "<pipe> ssh")]),
    ("py -m venv env", []),
    ("grep -n \"python3 -c 'go'\" *.sh", []),
    ("make # && python3 -c go\ndate", []),
    ("notpython go.py; pythonic -c go", []),
    (None, []),
]


@pytest.mark.parametrize("command, expected", CASES)
def test_command(command, expected):
    assert [(s, label) for s, label, _ in extract(command)] == expected


@pytest.mark.parametrize("command", ["'", '"', "python3 <<", "<", "$(", "`", "((", "python3 -c", "a\\", "&&|;", "python3 <<E"])
def test_broken_commands_never_fail(command):
    extract(command)


def test_folders():
    assert [f for _, _, f in extract("cd a; cd b && python3 s.py; (python3 /t.py)")] == ["a/b/s.py", "/t.py"]


def test_depth():
    assert extract("bash -c 'python3 -c x'", depth=0) == []


def test_argv():
    runs = lambda *args: next(((k, v) for k, v in vars(classify_argv(list(args))).items() if v not in (None, False)), None)
    assert runs("-W", "error", "-Xutf8", "job.py", "-c", "no") == ("script", "job.py")
    assert runs("-Bmvenv", "x") == ("module", "venv") and runs("-m") == ("module", "") and runs("-Ic") == ("code", "")
    assert runs() == runs("-i") == runs("-", "x") == runs("-W") == ("stdin", True)
    assert runs("-3.11", "--check-hash-based-pycs", "always", "--quiet", "a") == ("script", "a") and runs("--", "-c") == ("script", "-c")
    assert runs("-uV", "a") is runs("--help") is runs("-?") is runs("--") is None


def test_scripts_come_from_a_table(spark):
    calls = spark.createDataFrame([(1, "python3 a.py"), (2, "python3 b.py"), (3, "python3 c.py")], "id int, command string")
    files = spark.createDataFrame([("a.py", "x"), ("c.py", "y" * (x.MAX_BYTES + 1))], "path string, content string")
    got = {r.id: (r.source, r.label) for r in x.extract_all(calls, files=files).collect()}
    assert got == {1: ("x", "a.py"), 2: ("", "b.py (unreadable)"), 3: ("", "c.py (too large)")}


def test_lines_that_look_like_python(spark):
    yes = ["import os.path", "  from a import b", "async  def f (", "class C", "if x:  # why", "else:", "a.b[0] <<= 2", "print (1)", "return", "yield x", "@wrap", "prose\nx = 1", "lambda: 0"]
    no = ["", "important news", "from here on", "a == b", "if only", "defer (x)", "printed(1)", "we return", "x : y", "classes", "@ noon"]
    from pyspark.sql import functions as F

    from snipscan.functions.text import looks_like_python

    df = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, y boolean")
    assert [r.t for r in df.where(looks_like_python(F.col("t")) != F.col("y")).collect()] == []


def test_payloads(spark):
    rows = [
        {"tool_name": "Bash", "tool_input": {"command": "python -c 'x=1'"}, "session_id": "abcdefghijk"}, {"tool": "python", "args": {"code": "print(3)"}}, {"tool": "new", "input": {"script": "just prose", "args": ["python3", "-c", "1"]}},
        {"tool": "NotebookEdit", "tool_input": {"cell_type": "markdown", "new_source": "x"}}, {"tool": "Read", "tool_input": {"code": "x=1"}}, {"tool": "new", "tool_input": {"source": "import os"}}, {"tool": "python", "args": {}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(8, "no json"), (9, None), (10, "[1]")], "id int, payload string")
    got = {r.id: (r.source, r.label) for r in x.in_payloads(df).collect()}
    assert got == {0: ("x=1", "python -c"), 1: ("print(3)", "python"), 2: ("1", "python -c"), 5: ("import os", "new")}
    assert df.where("id = 0").select(x.origin(df.payload)).first()[0] == "hook:abcdefgh"
