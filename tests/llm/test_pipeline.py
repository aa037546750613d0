from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from test_order_minhash import brute
from test_packing import check

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1] if tables else docs, sf).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    kept, lines, near, mixed, packed = ([r for r in t.collect()] for t in tables)
    ids = [{r.doc_id for r in rows} for rows in (kept, lines, near, mixed)]
    assert ids[0] == ids[1] and ids[2] <= ids[1] and ids[3] <= ids[2]
    found = brute([(r.doc_id, r.text) for r in lines])
    assert ids[2] == set(found.values())
    check([(r.doc_id, r.text) for r in mixed], packed)


def test_odd_rows_and_clashing_columns(spark, sf, make, tmp_path):
    rng = random.Random(3)
    text = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    one = text(80)
    rows = [(1, None), (2, ""), (3, one), (4, one + " end"), (5, text(70), None), (5, text(70), None), (None, text(90)), (None, text(60)), (6, text(30_000)), (7, text(60)), (7, text(60)), (8, "\n".join(["a line that all have"] * 2) + " " + text(60))]
    rows += [rows[9], rows[9]]
    extra = {"_removed": "a", "_size": "b", "_rules": "c", "doc": "d", "class_id": "e", "id": "f", "digest": "g", "_block": "h", "draws": "i", "piece": "j", "_lines": "k"}
    docs = make(rows, extra)
    for stage, (name, apply) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        apply(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if stage < 4:
            assert docs.columns == before and {tuple(r[k] for k in extra) for r in got} == {tuple(extra.values())}
        if stage == 0:
            assert not {r.doc_id for r in got} & {1, 2} and len(got) == 12
        if stage == 2:
            assert sorted(r.doc_id or 0 for r in got) == [0, 0, 3, 5, 5, 6, 7, 7, 8]
    assert {r.doc_id for r in got} <= {3, 5, 6, 7, 8, None} and max(r.piece for r in got if r.doc_id == 6 or r.doc_id is None) >= 0


def test_an_empty_table_runs_through(spark, sf, make, tmp_path):
    docs = make([(1, "x")]).limit(0)
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_run_gives_pieces(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_the_rest_works_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "snipscan", tmp_path / "snipscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reports' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
