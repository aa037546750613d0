"""What the walk and the classification notice, and what they leave alone."""

from __future__ import annotations

import pytest

from snipscan.operators import digest, events
from snipscan.operators.classify import classify, third_party
from snipscan.operators.facts import distinct_sources, unfold, with_facts
from snipscan.sources.walker import facts

#: name: (source, hits as (effect, severity, verb, target))
CLAIMS = {
    "a file by name": ("rows = open('stock.tsv')", [("fs_read", 0, "read", "stock.tsv")]),
    "keyword mode": ("open('log/day1', mode='wb')", [("fs_write", 1, "truncate", "log/day1")]),
    "appending": ("with open('journal', 'at') as j:\n    pass", [("fs_write", 1, "append", "journal")]),
    "both ways": ("open('index.db', 'rb+')", [("fs_write", 1, "update", "index.db")]),
    "new only": ("open('once.lock', 'x')", [("fs_write", 1, "create", "once.lock")]),
    "name of a literal": ("from shutil import rmtree\nCACHE = 'build/cache'\nif stale:\n    rmtree(CACHE)", [("fs_delete", 2, "rmtree", "build/cache")]),
    "name given anew": ("import os\nold = 'a.log'\nold = newest()\nos.remove(old)", [("fs_delete", 2, "delete", "old")]),
    "method of a path": ("import pathlib\npathlib.Path('/srv/q').rmdir()", [("fs_delete", 2, "rmdir", "pathlib.Path('/srv/q')")]),
    "words of a command": ("from subprocess import check_output as co\nco(('du', '-s', '/srv'))", [("process", 2, "run", "du -s /srv")]),
    "joined path": ("import pathlib\nroot = pathlib.Path('out')\n(root / 'sub').write_bytes(b'')", [("fs_write", 1, "write", "root / 'sub'")]),
    "telling method": ("frame = load()\nframe.to_parquet('p.parquet')", [("fs_write", 1, "write", "p.parquet")]),
    "method of a handle": ("with open('notes.md', 'w') as out:\n    out.write(body)", [("fs_write", 1, "truncate", "notes.md"), ("fs_write", 1, "write", "open('notes.md', 'w')")]),
    "another name": ("import os\nrun = os.system\nfor job in jobs:\n    run('make clean')", [("process", 2, "shell", "make clean")]),
    "attribute by string": ("import os\nwipe = getattr(os, 'unlink')\nwipe('tmp.bin')", [("fs_delete", 2, "delete", "tmp.bin")]),
    "all names": ("from shutil import *\nrmtree('old')", [("fs_delete", 2, "rmtree", "old")]),
    "module by string": ("__import__('shutil').rmtree('x')", [("fs_delete", 2, "rmtree", "x"), ("dynamic", 2, "import", "shutil")]),
    "a name of one's own": ("open = lambda *a: None\nopen('k', 'w')", []),
    "only inside": ("def read(open, what):\n    return open(what, 'w')\nopen('top', 'a')", [("fs_write", 1, "append", "top")]),
    "methods don't hide": ("class Calc:\n    def exec(self, text):\n        return text\nexec(script)", [("dynamic", 2, "exec", "script")]),
    "a secret": ("import os\ntoken = os.environ.get('DB_PASSWORD')", [("env", 2, "getenv", "DB_PASSWORD")]),
    "no secret": ("from os import getenv\ngetenv('LANG')", [("env", 0, "getenv", "LANG")]),
    "variable set": ("import os\nos.environ['TZ'] = zone", [("env", 1, "setenv", "TZ")]),
    "variable gone": ("import os\ndel os.environ['TZ']", [("env", 1, "unsetenv", "TZ")]),
    "the arguments": ("import sys\nprint(len(sys.argv))", [("stdout", 0, "print", "len(sys.argv)"), ("env", 0, "argv", None)]),
    "numbers": ("import pandas as pd\npd.concat(parts)", [("compute", 0, "compute", "pandas")]),
    "said, not done": ("print('then sudo rm -rf build')", [("stdout", 0, "print", "then sudo rm -rf build")]),
    "a file of secrets": ("open('/etc/passwd').read()", [("fs_read", 2, "read", "/etc/passwd"), ("fs_read", 0, "read", "open('/etc/passwd')")]),
    "sums": ("import math\ntotal = sum(math.sqrt(k) for k in range(7))", []),
    "decorated": ("import os\n@cache(os.getenv('CACHE_TOKEN'))\ndef f():\n    os.rmdir('d')", [("env", 2, "getenv", "CACHE_TOKEN"), ("fs_delete", 2, "rmdir", "d")]),
    "cases": ("import os\nmatch mode:\n    case 'wipe':\n        os.remove('w')\n    case _:\n        open('keep')", [("fs_delete", 2, "delete", "w"), ("fs_read", 0, "read", "keep")]),
    "after a statement of Python 2": ("import os\nprint 'gone'\nos.system('id -u')", [("process", 2, "shell", "id -u")]),
    "after an open bracket": ("import os\nsizes = (\nos.system('ls')", [("process", 2, "shell", "ls")]),
    "under a broken head": ("import shutil\ndef clean(:\n    shutil.rmtree('/data')", [("fs_delete", 2, "rmtree", "/data")]),
    "beside a broken line": ("class A:\n    def f(self):\n        n = 1 +\n        open('in')\n    def g(self):\n        return eval('n')", [("fs_read", 0, "read", "in"), ("dynamic", 2, "eval", "n")]),
    "in a handler of a broken body": ("try:\n    a b\nexcept E:\n    open('log', 'a')", [("fs_write", 1, "append", "log")]),
    "blank": ("", []),
}


@pytest.fixture(scope="module")
def claimed(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CLAIMS.items()], "snippet_id string, source string")
    got: dict[str, list] = {}
    for h in digest.order_hits(digest.dedup_hits(classify(with_facts(df)))).orderBy("snippet_id", "pos").collect():
        got.setdefault(h.snippet_id, []).append((h.effect, h.severity, h.verb, h.target))
    return got


@pytest.mark.parametrize("name", list(CLAIMS))
def test_claim(claimed, name):
    assert sorted(claimed.get(name, []), key=str) == sorted(CLAIMS[name][1], key=str)


@pytest.mark.parametrize("source", ["a" + ".b" * 10_000, "(" * 5_000, "x = [" * 150 + "]" * 150, "\0", "if x:\n" + "".join(" " * i + "if x:\n" for i in range(1, 120)), "'" * 7, "a = 1\r\nb = 2\r\n", "é = 'a'; open(é)"])
def test_never_fails(source):
    assert facts(source)["counters"]["lines_total"] >= 0


@pytest.mark.parametrize("broken", ["x = (\n", '"""text\n', "def f(:\n    a = 1\n", "if x:\n\ty\n        z\n", "class\n", "@d\n", "a b c\n" * 50, "    indented\n"])
def test_lines_keep_their_numbers_after_broken_ones(broken):
    source = "import os\n" + broken + "os.remove('last')\n"
    got = facts(source)
    assert not got["parsed"] and got["problems"][0][0] == "error"
    assert [(c[2], c[9]) for c in got["calls"]] == [(len(source.splitlines()), ["last"])]


def test_columns_hold_what_the_walk_told():
    import pyarrow as pa

    from snipscan.operators import facts as columns

    def plain(v):
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    def values(v):
        if isinstance(v, dict):
            return [values(x) for x in v.values()]
        return [values(x) for x in v] if isinstance(v, (list, tuple)) else v

    told = [facts(code) for code, _ in CLAIMS.values()]
    for part, kind in columns._TYPES.items():
        want = [f[part] for f in told]
        got = columns._column(want, kind)
        assert got.type == kind and len(got) == len(told)
        if part == "calls":
            want = [[(*c[:10], list(c[10].items()), *c[11:]) for c in calls] for calls in want]
        if part == "counters":
            want = [{k: v[k] for k in columns.COUNTERS} for v in want]
        assert [values(v) for v in got.to_pylist()] == [values(v) for v in plain(want)]
    assert columns._column([], pa.struct([("a", pa.list_(pa.int32()))])).to_pylist() == []


def test_many_open_brackets_take_no_square_time():
    import time

    start = time.perf_counter()
    assert len(facts("".join(f"x{i} = (\n" for i in range(3_000)) + "open('end')\n")["calls"]) == 1
    assert time.perf_counter() - start < 10


def test_whatever_fails_is_fenced(monkeypatch, spark):
    from snipscan.sources import walker

    def fail(self, body, parent):
        raise KeyError("odd")

    monkeypatch.setattr(walker.Walk, "block", fail)
    got = facts("import os\nos.remove('x')\n")
    assert got["failed"] and not got["parsed"] and got["calls"] == [] and got["counters"]["lines_total"] == 2
    assert [p[:2] for p in got["problems"]] == [("error", "this snippet could not be analysed: KeyError: 'odd'")]


def test_documents_have_every_part(spark):
    import json

    source = "import os\nimport numpy as np\n\nb = 1\na = b\nfor p in os.listdir('d'):\n    # look\n    print(p, np.mean([1]), np.mean([2]))\ndef unused():\n    pass\n"
    df = spark.createDataFrame([(1, "one.py", source), (2, None, "  \n"), (3, "bad", "x = (")], "snippet_id int, name string, source string")
    got = {r.snippet_id: json.loads(r.report) for r in events.documents(df, name="name").collect()}
    r = got[1]
    assert list(r) == ["schema", "meta", "spine", "imports", "effects", "symbols", "bindings", "metrics", "texture", "diagnostics", "source"]
    assert r["meta"] == {"name": "one.py", "bytes": len(source), "parsed": True, "synopsis": "reads d → computes with numpy → prints results", "headline": ["reads d", "computes with numpy", "prints results"]}
    assert [(b["line"], b["name"], b["dead"]) for b in r["bindings"]] == sorted((b["line"], b["name"], b["dead"]) for b in r["bindings"])
    assert [(s["canonical"], s["group"], s["origin"], s["count"], s["lines"]) for s in r["symbols"]] == [("numpy.mean", "numpy", "import", 2, [8]), ("print", "<builtins>", "builtin", 1, [8]), ("os.listdir", "os", "import", 1, [6])]
    assert [(c["kind"], c["blank"], c["comment"], c["severity"]) for c in r["texture"]][:8] == [("import", False, False, None), ("import", False, False, None), (None, True, False, None), ("assign", False, False, None), ("assign", False, False, None), ("loop", False, False, "info"), (None, False, True, None), ("call", False, False, "info")]
    drawn = lambda n: [n["label"], *map(drawn, n["children"])]
    assert drawn(r["spine"]) == ["one.py", ["import os"], ["import numpy as np"], ["b = 1"], ["a = b"], ["for p in os.listdir('d')", ["print(p, np.mean([1]), np.mean([2]))"]], ["def unused()", ["pass"]]]
    assert list(r["spine"]) == ["id", "kind", "label", "detail", "line", "end_line", "depth", "own_effects", "effects", "severity", "weight", "children"] and r["spine"]["weight"] == 9
    assert r["source"] == source.splitlines() and r["metrics"]["risk"] == 4 and r["metrics"]["lines_code"] == 8
    assert got[2]["meta"]["synopsis"] == "nothing to run" and got[2]["meta"]["headline"] == [] and got[2]["meta"]["name"] == "<snippet>"
    assert not got[3]["meta"]["parsed"] and got[3]["diagnostics"][0]["level"] == "error"


def test_columns_are_characters():
    assert [c[3] for c in facts("é = 'a'; open(é)")["calls"]] == [10]


def test_third_party_and_deferred(spark):
    df = spark.createDataFrame([("a", "import os\nimport numpy as np\nfrom . import x\ndef f():\n    import requests\n")], "snippet_id string, source string")
    got = third_party(unfold(with_facts(df, ("imports",)), "imports")).orderBy("pos").collect()
    assert [(r.module, r.third_party, r.deferred) for r in got] == [("os", False, False), ("numpy", True, False), (".", False, False), ("requests", True, True)]


def test_reports_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "def f():\n    pass\n")], "snippet_id string, source string")
    got = {r.snippet_id: (r.risk, r.band, r.synopsis) for r in events.reports(df).collect()}
    assert got == {"a": (0, "inert", "nothing to run"), "b": (0, "inert", "nothing to run"), "c": (0, "inert", "no side effects — defines 1 function")}


def test_sources_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "snippet_id int, source string")
    once, keyed = distinct_sources(df)
    assert once.count() == 2 and keyed.count() == 4


def test_user_rules(spark):
    from snipscan.functions import catalog

    rules = catalog.rule_table(spark).unionByName(spark.createDataFrame([("mine.go", "net", "caution", "go", "0", "our own")], catalog.rule_table(spark).schema))
    df = spark.createDataFrame([("a", "import mine\nmine.go('there')")], "snippet_id string, source string")
    assert [(h.effect, h.target, h.note) for h in classify(with_facts(df), rules).collect()] == [("net", "there", "our own")]
