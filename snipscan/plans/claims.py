"""Queries over sources written for one thing each, and SQL that states by hand what has to be found in them.

Every row of ``part`` stands for one of the sources, with its key in place of {k}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.operators import classify, digest, events, facts, policy
from snipscan.plans.corpus import MADE_EVENTS, dealt, made_events, table
from snipscan.plans.queries import STATS, longs, query
from snipscan.plans.streams import feed_lines, shared_folder
from snipscan.streaming import feed


def _sources(spark, sf, texts: list[str]) -> DataFrame:
    text = F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts)).cast("int"))
    return dealt(table(spark, sf, "part").select("p_partkey")).select(F.col("p_partkey").alias("snippet_id"), F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("source"))


def _values(rows: list[tuple]) -> str:
    said = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


#: Names and scopes: a source, and its hits as (line, column, verb, target).
NAMES = [
    ("from shutil import rmtree\nCACHE = 'c{k}'\nif stale:\n    rmtree(CACHE)", [(4, 5, "rmtree", "c{k}")]),
    ("import os\nold = 'a'\nold = newest()\nos.remove(old)", [(4, 1, "delete", "old")]),
    ("open = lambda *a: None\nopen('k{k}', 'w')", []),
    ("def read(open, what):\n    return open(what, 'w')\nopen('top{k}', 'a')", [(3, 1, "append", "top{k}")]),
    ("class Calc:\n    def exec(self, text):\n        return text\nexec(script)", [(4, 1, "exec", "script")]),
    ("import os\nrun = os.system\nfor job in jobs:\n    run('make {k}')", [(4, 5, "shell", "make {k}")]),
    ("import os\nwipe = getattr(os, 'unlink')\nwipe('t{k}')", [(3, 1, "delete", "t{k}")]),
    ("from shutil import *\nrmtree('o{k}')", [(2, 1, "rmtree", "o{k}")]),
    ("__import__('shutil').rmtree('x{k}')", [(1, 1, "rmtree", "x{k}"), (1, 1, "import", "shutil")]),
    ("import pathlib\nroot = pathlib.Path('out')\n(root / 's{k}').write_bytes(b'')", [(3, 1, "write", "root / 's{k}'")]),
    ("é = 1; open('é{k}')", [(1, 8, "read", "é{k}")]),
    ("import os\n@cache(os.getenv('CACHE_TOKEN'))\ndef f():\n    match k:\n        case 'w':\n            os.rmdir('d{k}')", [(2, 8, "getenv", "CACHE_TOKEN"), (6, 13, "rmdir", "d{k}")]),
    ("with open('n{k}', 'w') as out:\n    out.write(body)", [(1, 6, "truncate", "n{k}"), (2, 5, "write", "open('n{k}', 'w')")]),
]


@query(f"with x(i, line, col, verb, target) as (values {_values([(i, *h) for i, (_, hits) in enumerate(NAMES) for h in hits])}) select p_partkey as snippet_id, cast(line as bigint) as line, cast(col as bigint) as col, verb, replace(target, '{{k}}', p_partkey::varchar) as target from part join x on p_partkey % {len(NAMES)} = i")
def names_and_scopes(spark, sf):
    hits = classify.classify(facts.with_facts(_sources(spark, sf, [text for text, _ in NAMES])))
    return longs(digest.dedup_hits(hits), "line", "col").select("snippet_id", "line", "col", "verb", "target")


#: Bindings: a source, and (name, kind, value, scope, line, depth, rebinds, accumulates, reads) by line and name.
BINDINGS = [
    ("total = 0\nfor n in rows{k}:\n    total += n\nprint(total)\n", [("total", "assign", "number", "<module>", 1, 0, 1, True, 1), ("n", "loop_var", "unknown", "<module>", 2, 0, 0, False, 1)]),
    ("def f{k}(a, *b, c=1):\n    with open(a) as h:\n        return [x for x in h]\n", [("a", "param", "unknown", "f{k}", 1, 1, 0, False, 1), ("b", "param", "unknown", "f{k}", 1, 1, 0, False, 0), ("c", "param", "unknown", "f{k}", 1, 1, 0, False, 0), ("f{k}", "def", "callable", "<module>", 1, 0, 0, False, 0), ("h", "with_var", "file", "f{k}", 2, 1, 0, False, 1), ("x", "comprehension", "unknown", "f{k}", 3, 1, 0, False, 1)]),
    ("import os\nif (m := os.getcwd()) and m:\n    p, (q, *r) = {k}, m\ntry:\n    pass\nexcept OSError as e:\n    print(e)\n", [("m", "walrus", "unknown", "<module>", 2, 0, 0, False, 2), ("p", "assign", "unknown", "<module>", 3, 0, 0, False, 0), ("q", "assign", "unknown", "<module>", 3, 0, 0, False, 0), ("r", "assign", "seq", "<module>", 3, 0, 0, False, 0), ("e", "except_var", "unknown", "<module>", 6, 0, 0, False, 1)]),
    ("class C{k}(Base):\n    size: int = {k}\n    def g(self):\n        self.x = d = {}\n        d = None\n        return d\n", [("C{k}", "class", "class", "<module>", 1, 0, 0, False, 0), ("size", "annotate", "number", "C{k}", 2, 1, 0, False, 0), ("g", "def", "callable", "C{k}", 3, 1, 0, False, 0), ("self", "param", "unknown", "C{k}.g", 3, 2, 0, False, 1), ("d", "assign", "map", "C{k}.g", 4, 2, 1, False, 1)]),
]


@query(f"with x(i, pos, name, how, value, scope, line, depth, rebinds, accumulates, reads) as (values {_values([(i, p, *b) for i, (_, found) in enumerate(BINDINGS) for p, b in enumerate(found)])}) select p_partkey as snippet_id, cast(pos as bigint) as pos, replace(name, '{{k}}', p_partkey::varchar) as name, how as kind, value, replace(scope, '{{k}}', p_partkey::varchar) as scope, cast(line as bigint) as line, cast(depth as bigint) as depth, cast(rebinds as bigint) as rebinds, accumulates, cast(reads as bigint) as reads, reads = 0 as dead from part join x on p_partkey % {len(BINDINGS)} = i")
def binding_kinds(spark, sf):
    b = digest.bindings_of(facts.with_facts(_sources(spark, sf, [text for text, _ in BINDINGS]), ("bindings", "reads")))
    return longs(b, "pos", "line", "depth", "rebinds", "reads").select("snippet_id", "pos", "name", "kind", "value", "scope", "line", "depth", "rebinds", "accumulates", "reads", "dead")


#: Statements: a source, and its nodes as (id, parent, kind, label, detail, line, last line), without the module.
STATEMENTS = [
    ("async def g{k}(x: int, *, y=2) -> str:\n    await h(x)\n    raise ValueError(x) from None\n", [(1, 0, "def", "async def g{k}(x, y)", "→ str", 1, 3), (2, 1, "call", "await h(x)", None, 2, 2), (3, 1, "raise", "raise ValueError(x)", None, 3, 3)]),
    ("while k < {k}:\n    k += 1\n    if k % 2:\n        continue\n    elif not k:\n        break\n    else:\n        del d[k]\nelse:\n    assert k, 'no'\n", [(1, 0, "loop", "while k < {k}", None, 1, 10), (2, 1, "assign", "k += 1", None, 2, 2), (3, 1, "branch", "if k % 2", None, 3, 8), (4, 3, "jump", "continue", None, 4, 4), (5, 3, "branch_arm", "elif not k", None, 5, 6), (6, 5, "jump", "break", None, 6, 6), (7, 3, "branch_arm", "else", None, 8, 8), (8, 7, "delete", "del d[k]", None, 8, 8), (9, 1, "branch_arm", "else", None, 10, 10), (10, 9, "assert", "assert k", None, 10, 10)]),
    ("@wrap\nclass K{k}(A, B):\n    '''what it is'''\n    n: int = {k}\n    global z\n    pass\n", [(1, 0, "class", "class K{k}(A, B)", None, 1, 6), (2, 1, "expr", '"""docstring"""', "what it is", 3, 3), (3, 1, "assign", "n: int = {k}", None, 4, 4), (4, 1, "global", "global z", None, 5, 5), (5, 1, "pass", "pass", None, 6, 6)]),
    ("try:\n    with a as b, c():\n        x = y = {k}\nexcept (E, F) as g:\n    return\nfinally:\n    lambda q: q + {k}\n", [(1, 0, "try", "try", None, 1, 7), (2, 1, "with", "with a as b, c()", None, 2, 3), (3, 2, "assign", "x = y = {k}", None, 3, 3), (4, 1, "handler", "except (E, F) as g", None, 4, 5), (5, 4, "return", "return", None, 5, 5), (6, 1, "branch_arm", "finally", None, 7, 7), (7, 6, "expr", "lambda q: q + {k}", None, 7, 7)]),
    ("match p:\n    case [1, *rest]:\n        from . import m as n, o\n    case _:\n        print(f'{p!r} is {k}')\n", [(1, 0, "branch", "match p", None, 1, 5), (2, 1, "branch_arm", "case [1, *rest]", None, 2, 3), (3, 2, "import", "from . import m as n, o", None, 3, 3), (4, 1, "branch_arm", "case _", None, 4, 5), (5, 4, "call", "print(f'{p!r} is {k}')", None, 5, 5)]),
]


@query(f"with x(i, node_id, parent_id, node, label, detail, line, end_line) as (values {_values([(i, *n) for i, (_, nodes) in enumerate(STATEMENTS) for n in nodes])}) select p_partkey as snippet_id, cast(node_id as bigint) as node_id, cast(parent_id as bigint) as parent_id, node as kind, replace(label, '{{k}}', p_partkey::varchar) as label, detail, cast(line as bigint) as line, cast(end_line as bigint) as end_line from part join x on p_partkey % {len(STATEMENTS)} = i")
def statement_labels(spark, sf):
    n = facts.unfold(facts.with_facts(_sources(spark, sf, [text for text, _ in STATEMENTS]), ("nodes",)), "nodes").where("node_id > 0")
    return longs(n, "node_id", "parent_id", "line", "end_line").select("snippet_id", "node_id", "parent_id", "kind", "label", "detail", "line", "end_line")


#: What one source counts, beside lines.
COUNTED = "statements complexity functions classes async_defs calls imports loops branches handlers max_depth".split()
COUNTS = [(3, 1, 1, 0, 1, 2, 0, 0, 0, 0, 1), (7, 5, 0, 0, 0, 0, 0, 1, 2, 0, 3), (5, 1, 0, 1, 0, 0, 0, 0, 0, 0, 1), (5, 2, 0, 0, 0, 1, 0, 0, 0, 1, 2), (3, 3, 0, 0, 0, 1, 2, 0, 1, 0, 2)]


@query(f"with x(i, {', '.join(COUNTED)}) as (values {_values([(i, *c) for i, c in enumerate(COUNTS)])}) select p_partkey as snippet_id, {', '.join(f'cast({c} as bigint) as {c}' for c in COUNTED)} from part join x on p_partkey % {len(COUNTS)} = i")
def statement_counts(spark, sf):
    c = facts.with_facts(_sources(spark, sf, [text for text, _ in STATEMENTS]), ("counters",)).select("snippet_id", "facts.counters.*")
    return longs(c, *COUNTED).select("snippet_id", *COUNTED)


@query("""
with x(i, level, message, line, col, found) as (values (0, 'warning', 'an expression nested deeper than 256 levels was not analysed', 1, 261, 1), (1, 'warning', 'a block nested deeper than 96 levels was not analysed', 98, 98, 1))
select p_partkey as snippet_id, level, message, cast(line as bigint) as line, cast(col as bigint) as col, cast(found as bigint) as found from part join x on p_partkey % 2 = i""")
def nesting_limits(spark, sf):
    """Sources that are nested too deep are read as far as the limits go, and say so."""
    deep = "x{k} = " + "-" * 300 + "1\nopen('f')"
    deep = deep.replace("x{k} = ", "x = ")
    blocks = "".join(" " * i + "if x:\n" for i in range(99)) + " " * 99 + "open('a')\nopen('b')"
    f = facts.with_facts(_sources(spark, sf, [deep, blocks]), ("problems", "calls"))
    p = f.select("snippet_id", F.size("facts.calls").alias("found"), F.explode("facts.problems").alias("p")).select("snippet_id", "found", "p.*")
    return longs(p, "line", "col", "found").select("snippet_id", "level", "message", "line", "col", "found")


#: Imports in the order in which they are seen: (module, names, alias, line, third party, deferred).
IMPORTS = [
    ("import os.path as p\nimport numpy as np, json\nfrom ..pkg{k} import a as b, c\ndef f():\n    import yaml\ntry:\n    from rich import *\nexcept ImportError:\n    pass\n", [("os.path", "", "p", 1, False, False), ("numpy", "", "np", 2, True, False), ("json", "", None, 2, False, False), ("..pkg{k}", "a as b,c", None, 3, False, False), ("yaml", "", None, 5, True, True), ("rich", "*", None, 7, True, True)]),
    ("if x:\n    from . import k{k}\n", [(".", "k{k}", None, 2, False, False)]),
]


@query(f"with x(i, pos, module, names, alias, line, third, deferred) as (values {_values([(i, p, *m) for i, (_, found) in enumerate(IMPORTS) for p, m in enumerate(found)])}) select p_partkey as snippet_id, cast(pos as bigint) as pos, replace(module, '{{k}}', p_partkey::varchar) as module, replace(names, '{{k}}', p_partkey::varchar) as names, alias, cast(line as bigint) as line, third as third_party, deferred from part join x on p_partkey % {len(IMPORTS)} = i")
def import_order(spark, sf):
    i = classify.third_party(facts.unfold(facts.with_facts(_sources(spark, sf, [text for text, _ in IMPORTS]), ("imports",)), "imports"))
    return longs(i, "pos", "line").select("snippet_id", "pos", "module", F.array_join("names", ",").alias("names"), "alias", "line", "third_party", "deferred")


@query(f"with {MADE_EVENTS} select seq, cast(risk as bigint) as risk, band in ('routine', 'check', 'read') as routine, false as never from feed where risk > 50")
def over_a_limit(spark, sf):
    """Events riskier than a limit, and whether floors of warnings are met."""
    e = policy.over(made_events(spark, sf), 50)
    return longs(e, "risk").select("seq", "risk", policy.wants_warning(F.col("band"), "routine").alias("routine"), policy.wants_warning(F.col("band"), "never").alias("never"))


@query(f"with {MADE_EVENTS} select source, seq, row_number() over (partition by source order by seq desc) as rank from feed qualify rank <= 16")
def recent_16(spark, sf):
    return longs(events.recent(made_events(spark, sf), 16, "source"), "rank").select("source", "seq", "rank")


@query(f"with {MADE_EVENTS} select source, arg_max(seq, risk * 100000000000 + case band when 'read' then 3 when 'check' then 2 when 'routine' then 1 else 0 end * 10000000000 - seq) as seq from feed group by source")
def worst_by_band(spark, sf):
    return events.worst_of(made_events(spark, sf), "source", by_band=True).select("source", "seq")


@query(f"with {MADE_EVENTS} select source, {STATS} from feed group by source")
def stream_totals(spark, sf):
    """Session totals as a stream gives them: the feed's files come in, the last state of each source is what has to be found."""
    folder = shared_folder(spark)
    feed_lines(spark, sf).select("value").write.text(f"{folder}/feed")
    totals = feed.running_totals(feed.read_stream(spark, f"{folder}/feed"), "source")
    put = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/totals/{number}")
    totals.writeStream.foreachBatch(put).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    told = spark.read.parquet(f"{folder}/totals/*")
    rest = [c for c in told.columns if c not in ("source", "batch")]
    return told.groupBy("source").agg(F.max_by(F.struct(*rest), "batch").alias("t")).select("source", "t.*")


@query(f"""with {MADE_EVENTS}, g as (select *, case when ts - lag(ts) over (partition by source order by ts) < 2231000 then 0 else 1 end as opens from feed),
s as (select *, sum(opens) over (partition by source order by ts rows unbounded preceding) as n from g)
select source, cast(min(ts) as bigint) as start, count(*) as events, count(*) filter (blocked) as blocked from s group by source, n""")
def session_windows(spark, sf):
    """Sessions by source that end after 37 minutes and 11 seconds without an event."""
    w = feed.sessions(made_events(spark, sf), "37 minutes 11 seconds")
    return w.select("source", F.unix_millis("session_window.start").alias("start"), "events", "blocked")
