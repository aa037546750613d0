from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from snipscan.llm import packing, tokens
from snipscan.llm.queries import QUERIES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["It's <|endoftext|> x", "ΑΣ σ", "a\x1cb", "Éx", "", None, "don't.stop ...a.b c!d ª.º x² 'll y'd.", "A\xa0b.c\x85d", "ß. ÿ, ÷x «a».", "日本語 text", "a_b __ c1.5 12,3", "Xİy", "!!. a,,b '.'", "tab\tnew\nline\r\n"]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_cache_is_exact(documents):
    texts = [r.text for r in documents.limit(150).collect()] + ODD
    cache = tokens.TokenCache()
    for part in (texts, texts[::-1]):
        assert cache.encode(part) == [np.array(ids(t), "<u4").tobytes() for t in part]


def check(rows, out, capacity=2048):
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total, copies = 0, Counter(rows)
    for doc, text in rows:
        full = [*ids(text), 0]
        total += len(full)
        want = sorted((k, i, len(full[i : i + capacity]), zlib.crc32(np.array(full[i : i + capacity], "<u4").tobytes())) for k, i in enumerate(range(0, len(full), capacity)))
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc])
        assert got == sorted(want * copies[doc, text])
    assert sum(r.length for r in out) == total
    return len(sequences), -(-total // capacity)


def test_query(spark, sf, documents):
    used, least = check([(r.doc_id, r.text) for r in documents.collect()], QUERIES["op8_packing"](spark, sf).collect())
    assert used <= 1.01 * least + 1


def test_odd_rows(spark, tmp_path, make):
    rows = [*enumerate(ODD), (50, "w " * 5_000), (51, "same"), (51, "same"), (52, "x " * 2_047), (53, "x " * 2_048)]
    make(rows, {"piece": "p", "length": "l"}).write.parquet(str(tmp_path / "documents.parquet"))
    check(rows, QUERIES["op8_packing"](spark, str(tmp_path)).collect())
    make([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op8_packing"](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    h = np.bincount(np.minimum(capacity, rng.geometric(1 / (20 + 30 * seed), 5_000)), minlength=capacity + 1)
    h[100] += 4_000 * (seed % 2)
    used = np.zeros_like(h)
    plan = packing.plan_packing(h, capacity)
    for n, content in plan:
        assert sum(a * b for a, b in content) <= capacity
        for length, times in content:
            used[length] += n * times
    assert (used == h).all()
    assert sum(n for n, _ in plan) <= 1.1 * (h * np.arange(capacity + 1)).sum() / capacity + 2 + h[129:].sum() * (seed % 2)


def test_least_squares_finds_an_exact_mix():
    left = np.zeros(101, np.int64)
    left[[60, 40, 30, 70, 50]] = [100, 100, 50, 50, 40]
    patterns = np.array([[60, 40, 0, 0], [70, 30, 0, 0], [50, 50, 0, 0]])
    assert np.allclose(packing.fit_repeats(patterns, left), [100, 50, 20], atol=0.5)
    assert packing.plan_packing(np.zeros(101, np.int64), 100) == []


def test_workers_keep_no_words_after_a_task(spark, documents):
    assert packing.pieces(documents.repartition(8)).count() >= documents.count()

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"words": [len(c.words) for c in tokens._CACHES.values()] or [-1]})

    words = [r.words for r in spark.range(64).repartition(64).mapInArrow(kept, "words bigint").collect()]
    # workers are used again, so some hold a tokenizer, and none the words of a task that is over
    assert max(words) == 0
