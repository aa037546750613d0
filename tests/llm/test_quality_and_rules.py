from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest

from snipscan.llm import quality_gam, rule_forest, toxicity_ftrl
from snipscan.llm.queries import QUERIES
from snipscan.llm.textstats import text_counts

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


TEXTS = ["", None, " \n\t", "a", "é ü ß | #", "a b c a b c", "x\nx\n\nx ", "w " * 300, "|" * 70 + " " + "z" * 500, "a\x0bb\x1cc d", "line one here\nline one here\n" * 3, "日本 語 " * 40]


def test_counts_against_brute_force(documents):
    texts = TEXTS + [r.text for r in documents.limit(200).collect()]
    got = text_counts([(t or "").encode() for t in texts])
    assert [tuple(map(int, r)) for r in got.iloc[:, :5].to_numpy()] == [brute(t) for t in texts]


def test_rules_query(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    out = QUERIES["op5_rule_forest"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert not (failed and r.kept)


def test_rules_find_bad_and_keep_good(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = rule_forest.judge(docs, labels).join(labels.where("quality is not null"), "doc_id").where("not _rules.base_failed").select("quality", "_rules.kept").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.1


def test_rules_edges(make, spark, labels):
    docs = make([(1, None), (2, ""), (3, "w " * 60_000), (4, " ".join(f"word{i}" for i in range(80))), (4, " ".join(f"word{i}" for i in range(80))), (None, "x")], {"kept": "no", "n_words": "9"})
    out = rule_forest.keep_good(docs, labels)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [4, 4]
    assert rule_forest.judge(docs.limit(0), labels.limit(0)).count() == 0
    assert rule_forest.judge(docs, labels.limit(0)).where("_rules.kept").count() == 2


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = order[y == 1]
    return (pos.mean() - (len(pos) - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize("name, label, modulus, remainder, least", [("op2_quality_gam", "quality", 3, 1, 0.98), ("op4_toxicity_ftrl", "toxic", 5, 0, 0.95)])
def test_models_on_held_out_rows(spark, name, label, modulus, remainder, least):
    folder = "/root/testdata/sf0.1"
    out = QUERIES[name](spark, folder)
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % modulus == remainder for i in rows[rows.held_out].doc_id)
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = rows[rows.held_out]
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least
    assert (held.predicted == held[label]).mean() > 0.97
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_held_out_labels_are_never_used(spark, documents, labels):
    from pyspark.sql import functions as F

    from snipscan.llm.common import held_out

    for score, column, modulus, remainder in ((quality_gam.score_quality, "quality", 3, 1), (toxicity_ftrl.score_toxicity, "toxic", 5, 0)):
        flipped = labels.withColumn(column, F.when(held_out(F.col("doc_id"), modulus, remainder), 1 - F.col(column)).otherwise(F.col(column)))
        a, b = ({r.doc_id: r._score for r in score(documents, x).collect()} for x in (labels, flipped))
        assert a == b


def test_models_without_labels_and_odd_rows(make, labels):
    docs = make([(1, None), (2, ""), (3, "word " * 50_000), (None, "x"), (2, "")], {"score": "s", "_label": "l"})
    for score in (quality_gam.score_quality, toxicity_ftrl.score_toxicity):
        assert {r._score for r in score(docs, labels.limit(0)).collect()} == {0.5}
        got = score(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r._score <= 1 for r in got)
        assert score(docs.limit(0), labels).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_gam(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 1 << 20, 50), np.full(i % 2, 5))) for i in range(2000)]
    w = toxicity_ftrl.fit_ftrl(rows, np.array([i % 2 for i in range(2000)], float))
    assert 5 in w.at and len(w.at) < 200


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 0.1, (500, 3)), [[5.0, 5, 5]]))
    s = rule_forest.fit_forest(x[:500], x[500:]).score(x)
    assert s.argmax() == 500


def test_the_forest_decides_and_sees_raw_statistics(spark):
    """Bad rows are found by path lengths alone: with a forest grown on all rows alike, or a threshold of no labels, they aren't."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = rule_forest.labelled_counts(docs, labels, "quality", 12_000, 11)
    known = known[~rule_forest.base_failed(known)]
    good, x = (known["_label"] == 1).to_numpy(), rule_forest.statistics(known)
    half = np.arange(len(x)) % 2 == 0

    def caught(forest):
        odd = forest.score(x)
        limit = np.quantile(odd[good & half], 0.999)
        return (odd[~good & ~half] > limit).mean(), (odd[good & ~half] > limit).mean()

    found, lost = caught(rule_forest.fit_forest(x[good & half], x[~good & half]))
    assert found > 0.9 and lost < 0.01
    assert caught(rule_forest.fit_forest(x[half], x[:0]))[0] < 0.5


def scalar_gam(model, row):
    """One row's logit, table by table."""
    cell = lambda v, edges: sum(e <= v for e in edges)
    z = model.base + sum(model.tables[f][cell(v, model.edges[f])] for f, v in enumerate(row))
    return z + sum(t[cell(row[i], model.pair_edges[i])][cell(row[j], model.pair_edges[j])] for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True))


def scalar_path(forest, row):
    """Mean path length of one row, tree by tree."""
    z = [np.arcsinh((v - c) / s) for v, c, s in zip(row, forest.centre, forest.spread, strict=True)]
    total = 0.0
    for column, cut, path in zip(forest.column, forest.cut, forest.path, strict=True):
        node = 0
        while column[node] >= 0:
            node = 2 * node + (2 if z[column[node]] >= cut[node] else 1)
        total += path[node]
    return total / len(forest.path)


def test_vectorised_scores_against_slow_ones():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4)) ** 2
    gam = quality_gam.fit_gam(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.5).astype(float))
    assert np.allclose(gam.logit(x[:50]), [scalar_gam(gam, r) for r in x[:50]])
    forest = rule_forest.fit_forest(x[:300], x[300:])
    assert np.allclose(forest.score(x[:50]), [2 ** (-scalar_path(forest, r) / forest.norm) for r in x[:50]])


def test_toxicity_scores_against_slow_ones(documents):
    import pyarrow as pa

    texts = [r.text for r in documents.limit(60).collect()] + ["", None, "a b a b"]
    rng = np.random.default_rng(2)
    table = np.where(rng.random(1 << toxicity_ftrl.BITS) < 0.3, rng.normal(size=1 << toxicity_ftrl.BITS), 0).astype(np.float32)
    clean = toxicity_ftrl._clean(pa.array(texts))
    slow = []
    for t in clean:
        _, at = toxicity_ftrl._hashed([t])
        slow.append(0.5 + sum(float(table[k]) for k in set(at.tolist())))
    assert np.allclose(toxicity_ftrl.logits(table, 0.5, clean), slow, atol=1e-4)


def slow_ftrl(rows, y, seed):
    """FTRL-proximal as published, coordinate by coordinate."""
    t = toxicity_ftrl
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    l1 = t.L1 * len(y) / (len(y) + t.L1_ROWS)
    weight = lambda i: 0.0 if abs(z[i]) <= (l1 if i >= 0 else 0) else -(z[i] - (np.sign(z[i]) * l1 if i >= 0 else 0)) / ((t.BETA + n[i] ** 0.5) / t.ALPHA + t.L2)
    rng = np.random.default_rng(seed)
    for _ in range(t.EPOCHS):
        for k in rng.permutation(len(y)):
            at = [*rows[k].tolist(), -1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -30, 30))) - y[k]
            for i in at:
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / t.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_against_the_published_steps():
    rng = np.random.default_rng(4)
    y = np.array([i % 2 for i in range(300)], float)
    rows = [np.unique(np.append(rng.integers(0, 40, 6), [50 + i % 2] * 2)) for i in range(300)]
    got, want = toxicity_ftrl.fit_ftrl(rows, y, 3), slow_ftrl(rows, y, 3)
    assert dict(zip(got.at.tolist(), got.weight.tolist(), strict=True)) == pytest.approx({k: v for k, v in want.items() if k >= 0}, rel=1e-4)
    assert got.intercept == pytest.approx(want.get(-1, 0.0), rel=1e-6)


def test_long_texts_are_learnt_from(make, spark):
    """A word that only very long toxic texts have gets its weight."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join([f"w{k}" for k in rng.integers(0, 400, 3_000)] + ["vile"] * (i % 2))) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity_ftrl.score_toxicity(make(rows), labels).toPandas()
    assert auc(got._score.to_numpy(), (got.doc_id % 2).to_numpy()) > 0.99


def test_clashing_names_are_kept(make, labels):
    docs = make([(1, "a b c"), (2, None)], {"_score": "s", "_held_out": "h", "_rules": "r", "_counts": "c", "_label": "l"})
    for out, name in ((quality_gam.score_quality(docs, labels), "__score"), (toxicity_ftrl.score_toxicity(docs, labels), "__score"), (rule_forest.judge(docs, labels), "__rules"), (rule_forest.with_counts(docs), "__counts")):
        assert out.columns[-1] == name and out.columns[: len(docs.columns)] == docs.columns
        assert {(r._score, r._held_out, r._rules, r._counts) for r in out.collect()} == {("s", "h", "r", "c")}
    assert rule_forest.keep_good(docs, labels).columns == docs.columns


def test_kept_equals_a_scalar_forest_on_the_documents(spark, sf, documents, labels):
    """Each document of the query judged one by one: counts, statistics, path lengths tree by tree, threshold."""
    forest = rule_forest.fit_rules(documents, labels)
    got = {r.doc_id: r for r in QUERIES["op5_rule_forest"](spark, sf).collect()}
    seen = set()
    for r in documents.collect():
        row, n = got[r.doc_id], len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        if n < 50 or 100 * row.n_repeat_words > 50 * n:
            assert row.base_failed and not row.kept
            continue
        x = rule_forest.statistics(text_counts([r.text.encode()]))[0]
        odd = 2 ** (-scalar_path(forest, x) / forest.norm)
        assert odd == pytest.approx(row.anomaly) and row.kept == (odd <= forest.threshold)
        seen.add(row.kept)
    assert seen == {True, False}
