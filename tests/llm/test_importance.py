from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest

from compare import connect, differences
from snipscan.llm import importance
from snipscan.llm.queries import ORACLES, QUERIES


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, target, min_words=20, percent=10, run=1):
    """(id, features, weight, score, rank) of (id, text) rows, in order of rank, then of rows."""

    def buckets(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + run]).encode()) % 10_000 for i in range(len(w) - run + 1)]

    s = collections.Counter(b for _, t in docs for b in buckets(t))
    t = collections.Counter(b for x in target for b in buckets(x))
    S, T = s.total(), t.total()  # noqa: N806
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        rows.append([i, len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text)) >= min_words])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    sf = f"/root/testdata/{sf}"
    df = QUERIES["op12_importance"](spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert told(df) == brute(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert differences(df, connect(sf), ORACLES["op12_importance"]) == []


def test_hot_and_odd_rows(spark, make, monkeypatch):
    """Copies of a third of the rows dealt apart; null and empty texts, repeated rows, long texts, null ids, clashing names."""
    monkeypatch.setattr("snipscan.llm.skew.SPLIT_ROWS", 50)
    copy = "The same Words again, " * 10
    docs = [(i, copy) for i in range(150)] + [(i, f"own{i} Ärger und ÄRGER x_y-z {i} " * (i % 7)) for i in range(150, 400)]
    docs += [(400, None), (401, ""), (402, "a b " * 50_000), (403, copy), (403, copy), (None, copy), (None, None), (404, "\0\x1f ~~")]
    target = [(1, "own200 again the und"), (2, None), (3, "")]
    extra = {c: "0" for c in ("id", "digest", "weight", "at", "place", "part", "fit", "copies", "t")}
    got = importance.resample(make(docs, extra), make(target, extra))
    assert told(got) == brute(docs, [t for _, t in target])
    assert importance.resample(make([(1, "x")]).limit(0), make(target)).count() == 0
    assert told(importance.resample(make(docs[:300]), make(target).limit(0))) == brute(docs[:300], [])


def test_longer_runs_and_shares(spark, make):
    docs = [(i, f"a b c{i % 5} d e{i % 3} f " * (i % 11)) for i in range(60)]
    target = [(0, "c1 d e2 f a b")]
    got = importance.resample(make(docs), make(target), run=2, min_words=6, percent=50)
    assert told(got) == brute(docs, [t for _, t in target], 6, 50, 2)
