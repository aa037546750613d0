from __future__ import annotations

from compare import connect, differences
from snipscan.llm import line_dedup
from snipscan.llm.queries import ORACLES, QUERIES


def brute(rows, k):
    sites, first = {}, {}
    for i, text, site in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\r")
            if key:
                sites.setdefault(key, set()).add(site)
                first.setdefault(key, (i, p))
    out = {}
    for i, text, _ in rows:
        if text is None:
            out[i] = None
            continue
        keep = [x for p, x in enumerate(text.split("\n")) if not ((key := x.strip(" \t\r")) and len(sites[key]) >= k and first[key] != (i, p))]
        out[i] = "\n".join(keep)
    return out


def test_against_brute_force(make):
    rows = [(i, "\n".join([f"own {i}", "common" + " " * (i % 3), f"pair {i // 2}", "", f"mid {i % 4}"] + ["again", "again"] * (i == 3)), f"site{i % 7}") for i in range(60)] + [(100, None, "x"), (101, "", None), (102, "common\ncommon", None)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows), min_sites=4).collect()}
    assert got == brute(rows, 4)
    assert got[100] is None and got[101] == "" and got[0].count("common") == 1


def test_threshold_is_exact(make):
    rows = [(i, f"at {k}", f"s{i}") for k in (3, 4, 5, 6, 7) for i in range(k * 100, k * 100 + k)]
    gone = [r.doc_id for r in line_dedup.dedup_lines(make(rows), min_sites=5).where("_removed is not null").collect()]
    assert sorted(gone) == [i for k in (5, 6, 7) for i in range(k * 100 + 1, k * 100 + k)]


def test_repeated_rows_empty_and_clashing_columns(make, spark):
    docs = make([(1, "a\nb", "x"), (1, "a\nb", "x"), (2, "a", "y"), (3, "a", "z")], {"_removed": "me", "_lines": "7", "_of": "x", "removed": "y", "doc": "z", "_a": "1"})
    out = line_dedup.edit_documents(docs, min_sites=3)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "a\nb", 3), (1, "a\nb", 3), (2, "", 0), (3, "", 0)]
    assert {tuple(r)[5:] for r in out.collect()} == {("me", "7", "x", "y", "z", "1")}
    assert line_dedup.edit_documents(make([]).limit(0)).count() == 0


def test_long_text(make):
    rows = [(i, "\n".join(["shared"] * 20_000 + [f"own {i}"]), f"s{i}") for i in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got == brute(rows, 5)


def test_hot_lines_are_dealt_over_tasks(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "SPLIT_ROWS", 20)
    rows = [(i, f"everywhere\nown {i}\nat {i % 9}\neverywhere", f"s{i % 11}") for i in range(200)]
    seen, real = [], line_dedup._hot
    monkeypatch.setattr(line_dedup, "_hot", lambda wide: seen.append(real(wide)) or seen[-1])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got == brute(rows, 5) and seen[0].count() == 10


def test_query_equals_sql(spark, sf):
    assert differences(QUERIES["op1_line_dedup"](spark, sf), connect(sf), ORACLES["op1_line_dedup"]) == []
