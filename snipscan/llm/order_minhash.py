"""MinHash near-dedup that heeds the order of the text (order min-hash).

The k-mers of a text are its windows of WORDS words, in lower case, each labelled by how often it has stood before. Each of
SKETCHES hash functions takes the ELL k-mers with the smallest values and keeps them in the order of the text; two texts
meet in a bucket where such a tuple is equal. Candidates are verified by a banded alignment of their words: the words
matched in order over all words of both (an ordered Jaccard, which edits lower as they do the edit similarity) must reach
SIMILARITY. No alignment that reaches it leaves the band. Texts whose k-mers have an ordered Jaccard of SIMILARITY are always
like, for their words then have one too.

No bucket is expanded into all its pairs: its texts are compared with leaders, and what leaders leave apart is joined
exactly by its rarest k-mers (see ``snipscan.llm.buckets``). So of the texts that share a bucket, those whose k-mers have a
Jaccard of SIMILARITY are in one class for certain; texts with more edits, whose words alone are like, are where a leader of
a shared bucket is like both. Equal texts are one text throughout, known by a digest of 128 bits.

A text of fewer than WORDS words is one k-mer of all its words; one without a word has none, and is like others without a
word only where equal byte by byte. Null counts as the empty text; a very long text is read whole. A class is named by its
smallest id, null if none of its rows has one (its digest then tells it from others); of rows with the same id each belongs to the class of its own text. Repeated
rows are in one class. Ties of a hash are broken by the order in the text. An empty table gives an empty result. Columns of
any name are carried along in a struct, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.bitfield import bit_field, may_be_in, may_hold
from snipscan.llm.buckets import EPSILON, by_sifted_counts, crowded, link_buckets
from snipscan.llm.common import discard, materialize, small_batches
from snipscan.llm.skew import hot_keys, join_split
from snipscan.llm.textwords import U64, Words, as_bytes, chunks, mix

WORDS, SIMILARITY = 5, 0.8
#: Where one word in nine differs, the words reach SIMILARITY and some 42 % of the k-mers are shared: 24 pairs of them all differ in 1 % of the cases.
SKETCHES, ELL, LEADERS = 24, 2, 3
#: Texts of at most so many k-mers also meet by single k-mers: few of them survive an edit.
SHORT = 32
#: Bins of a bag of words, and what a bin says that holds as many words or more.
BINS, FULL = 256, 65_535
#: Bytes of a digest that a field of bits knows.
HEAD = 7
_MULTIPLY = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_ROWS = 1 << 15


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words in order."""
    words = Words(texts)
    return np.split(words.hashes(), np.cumsum(words.count)[:-1])


def kmers(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's k-mers in order."""
    words = Words(texts)
    h = words.hashes()
    at, gram = words.grams(h, WORDS)
    cuts = np.searchsorted(words.doc[at], np.arange(1, len(texts)))
    out = np.split(gram, cuts)
    first = np.cumsum(words.count) - words.count
    for i in np.flatnonzero((words.count > 0) & (words.count < WORDS)):
        v = np.zeros(1, U64)
        for x in h[first[i] : first[i] + words.count[i]]:
            v = mix(v * U64(0xD6E8FEB86659FD93) + x)
        out[i] = v
    return out


def labelled(gram: np.ndarray) -> np.ndarray:
    """Each element with its occurrence number, as one hash."""
    if not len(gram):
        return gram
    order = np.argsort(gram, kind="stable")
    s = gram[order]
    new = np.flatnonzero(np.concatenate((np.ones(1, bool), s[1:] != s[:-1])))
    nth = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    out = np.empty(len(s), U64)
    out[order] = mix(s + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def sketch(gram: np.ndarray) -> np.ndarray:
    """The text's bucket keys, one for each hash function, and as many of single k-mers for a short text."""
    if not len(gram):
        return np.zeros(0, np.int64)
    x = labelled(gram)
    ell = min(ELL, len(x))
    best = np.empty((SKETCHES, ell), np.int64)
    step = max(1, _ROWS * 8 // len(x))
    for lo in range(0, SKETCHES, step):
        v = x[None, :] * _MULTIPLY[lo : lo + step, None]
        v ^= v >> U64(32)
        v *= U64(0xD6E8FEB86659FD93)
        best[lo : lo + step] = np.argpartition(v, ell - 1, axis=1)[:, :ell] if len(x) > ell else np.arange(ell)
    best.sort(axis=1)
    key = np.arange(SKETCHES, dtype=np.uint64)
    for j in range(ell):
        key = mix(key * U64(0x100000001B3) + x[best[:, j]])
    if len(x) <= SHORT and ell > 1:
        key = np.concatenate((key, mix(x ^ U64(0x51ED270B))))
    return key.view(np.int64)


def _matched(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of a and b with positions at most ``band`` apart; bit-parallel, in a window that slides with the band."""
    at: dict[int, list[int]] = defaultdict(list)
    alphabet = {v: i for i, v in enumerate(dict.fromkeys(a.tolist()))}
    ca = [alphabet[v] for v in a.tolist()]
    cb = [alphabet.get(v, -1) for v in b.tolist()]
    found, lo, top = 0, 0, 0
    v, step = 0, 1024
    for r0 in range(0, len(cb), step):
        r1 = min(len(cb), r0 + step)
        new_lo, new_top = min(max(0, r0 - band), len(ca)), min(len(ca), r1 + band)
        drop = new_lo - lo
        if drop > 0:
            gone = v & ((1 << drop) - 1)
            found += min(drop, top - lo) - gone.bit_count()
            v >>= drop
        width = new_top - new_lo
        have = max(0, top - new_lo)
        v |= ((1 << (width - have)) - 1) << have
        lo, top = new_lo, new_top
        at.clear()
        for j in range(lo, top):
            at[ca[j]].append(j - lo)
        masks = {c: sum(1 << j for j in js) for c, js in at.items()}
        full = (1 << width) - 1
        for i in range(r0, r1):
            m = masks.get(cb[i], 0)
            if m:
                left, right = max(0, i - band - lo), i + band + 1 - lo
                m = (m >> left) << left
                if right < width:
                    m &= (1 << right) - 1
                u = v & m
                v = ((v + u) | (v - u)) & full
    return found + (top - lo) - v.bit_count()


def ordered_similarity(a: np.ndarray, b: np.ndarray, at_least: float = SIMILARITY) -> float:
    """Elements matched in order over all of both; below ``at_least`` some lower bound of it, often 0."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < at_least * max(n, m) - EPSILON:
        return 0.0
    least = at_least * (n + m) / (1 + at_least) - EPSILON
    same = min(n, m)
    head = int(np.argmin(np.append(a[:same] == b[:same], False)))
    tail_room = same - head
    tail = int(np.argmin(np.append(a[n - tail_room :][::-1] == b[m - tail_room :][::-1], False))) if tail_room else 0
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if len(x) and len(y):
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        if common + np.minimum(cx[i], cy[j]).sum() < least:
            return 0.0
        common += _matched(x, y, int(n + m - 2 * least) + 1)
    return common / (n + m - common)


def digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in as_bytes(texts)], pa.binary())


def _lower(texts: pa.Array) -> list[bytes]:
    return [x.lower().encode() if x else b"" for x in texts.to_pylist()]


def with_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the text's digest, its number of words and its bucket keys, for each row."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<digest: binary, n: int, keys: array<bigint>>")
    def sketched(texts: pa.Array) -> pa.Array:
        grams: list[np.ndarray] = []
        n: list[int] = []
        lower = _lower(texts)
        for lo, hi in chunks(lower):
            grams += kmers(lower[lo:hi])
            n += Words(lower[lo:hi]).count.tolist()
        return pa.StructArray.from_arrays([digests(texts), pa.array(n, pa.int32()), pa.array([sketch(g) for g in grams], pa.list_(pa.int64()))], names=["digest", "n", "keys"])

    return docs.select("doc_id", sketched.asNondeterministic()("text").alias("_s")).select("doc_id", "_s.*")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        ta, tb = (_lower(batch.column(c)) for c in ("text_a", "text_b"))
        keep = []
        for lo in range(0, len(a), 64):
            ha, hb = word_hashes(ta[lo : lo + 64]), word_hashes(tb[lo : lo + 64])
            keep += [lo + i for i, (x, y) in enumerate(zip(ha, hb, strict=True)) if ordered_similarity(x, y) >= SIMILARITY]
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])


def bags(texts: pa.Array) -> pa.Array:
    """How many words of each text fall into each of BINS bins by their hashes, as 16-bit numbers."""
    lower, out = _lower(texts), []
    for lo, hi in chunks(lower):
        words = Words(lower[lo:hi])
        cell = words.doc * BINS + (words.hashes() >> U64(40)).astype(np.int64) % BINS
        out.append(np.minimum(np.bincount(cell, minlength=(hi - lo) * BINS), FULL).astype("<u2").tobytes())
    data, size = b"".join(out), 2 * BINS
    return pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())


def may_be_like(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether bags leave room for SIMILARITY: two texts share no more words than their bins do. A full bin may hold more than it says."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, BINS).astype(np.int64) for c in (a, b))
    full = ((x == FULL) & (y == FULL)).any(axis=1)
    room = np.minimum(x, y).sum(axis=1) >= SIMILARITY / (1 + SIMILARITY) * (x.sum(axis=1) + y.sum(axis=1)) - EPSILON
    return pa.array(room | full | (x == FULL).any(axis=1) | (y == FULL).any(axis=1))


def _with_both(pairs: DataFrame, texts: DataFrame, column: str, others: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of a written table with a column of ``texts`` for each side, or of ``others`` for b. A text in very many pairs is dealt over several tasks."""
    left, right = (side.select(F.col("rep").alias(f"r{x}"), F.col(column).alias(f"{column}_{x}")) for x, side in (("a", texts), ("b", others or texts)))
    with_a = join_split(pairs.select("a", "b"), left, "a", "ra", hot=hot_keys(pairs, "a")).select("a", "b", f"{column}_a")
    return join_split(with_a, right, "b", "rb", hot=hot_keys(pairs, "b")).select("a", "b", f"{column}_a", f"{column}_b")


def _sifted(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """``texts`` without most of those whose ``rep`` is none of ``reps``, so that few whole texts are shuffled for a join with these."""
    wanted = materialize(reps.select(F.xxhash64("rep").alias("h")), "wanted")
    out = texts.where(may_be_in(wanted)(F.xxhash64("rep")))
    discard(wanted)
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose texts are near copies, as a written table. Bags rule most others out before whole texts are moved."""
    room = F.arrow_udf(may_be_like, "boolean")
    some = materialize(_with_both(pairs, texts, "bag").where(room("bag_a", "bag_b")).select("a", "b"), "pairs-left")
    # by shuffles: a broadcast would put the sift and the alignment into one stage, whose tasks take two workers each
    left, right = (_sifted(texts, some.select(F.col(x).alias("rep"))).hint("merge") for x in "ab")
    links = materialize(_with_both(some, left, "text", right).mapInArrow(_verify, "a binary, b binary"), "links")
    discard(some)
    return links


def _labelled_kmers(texts: DataFrame) -> DataFrame:
    """(rep, class, items): the labelled k-mers of each text."""
    small_batches(texts.sparkSession)

    @F.arrow_udf("array<bigint>")
    def items(column: pa.Array) -> pa.Array:
        lower = _lower(column)
        grams = [g for lo, hi in chunks(lower) for g in kmers(lower[lo:hi])]
        return pa.array([labelled(g).view(np.int64) for g in grams], pa.list_(pa.int64()))

    return texts.select("rep", "class", items.asNondeterministic()("text").alias("items"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of each row, and for each text its digest, its smallest id ``low``, and the ``class``, a digest. Both are written tables."""
    sketches = materialize(with_sketches(docs), "sketches")
    texts_of = materialize(sketches.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys")), "distinct-texts")
    met = crowded(texts_of.select(F.col("digest").alias("rep"), "n", F.explode("keys").alias("key")), sift=True)
    texts = materialize(_texts(docs, texts_of.select("digest", "low").join(met.select(F.col("rep").alias("digest")).distinct(), "digest", "left_semi")), "bucket-texts")
    classes = link_buckets(met, lambda pairs: verified(pairs, texts), SIMILARITY, LEADERS, lambda some: _labelled_kmers(_sifted(texts, some.select("rep")).join(some.hint("merge"), "rep")), by_sifted_counts)
    named = materialize(texts_of.join(classes, F.col("digest") == F.col("id"), "left").select("digest", "low", F.coalesce("class", "digest").alias("class")), "text-classes")
    rows = materialize(sketches.select("doc_id", "digest"), "row-digests")
    for done in (sketches, texts_of, met, texts, classes):
        discard(done)
    return rows, named


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_name) for each row of ``docs``: a class's smallest document id, null if it has none, and the digest of one of its texts, which tells all classes apart."""
    rows, named = _classes(docs.select("doc_id", "text"))
    names = named.groupBy("class").agg(F.min("low").alias("class_id"))
    texts = materialize(join_split(named.select("digest", "class"), names.withColumnRenamed("class", "_class"), "class", "_class", hot=hot_keys(named, "class")).select(F.col("digest").alias("_digest"), "class_id", F.lower(F.hex("class")).alias("class_name")), "class-names")
    return join_split(rows, texts, "digest", "_digest", hot=hot_keys(rows, "digest")).select("doc_id", "class_id", "class_name")


def _id_and_digest(docs: DataFrame, of=None) -> DataFrame:
    """The row as the struct doc, its id as text (null: empty), its text's digest, by ``of`` if that is given."""
    small_batches(docs.sparkSession)
    digest = (of or F.arrow_udf(digests, "binary")).asNondeterministic()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("doc"), F.coalesce(F.concat(F.lit("i"), F.col("doc_id")), F.lit("")).alias("id"), digest("text").alias("digest"))


def _texts(docs: DataFrame, used: DataFrame) -> DataFrame:
    """(rep, text, bag) of the texts of ``used`` (digest, low), from the row of the smallest id, so that of many copies one is moved."""
    head = F.conv(F.hex(F.substring("digest", 1, HEAD)), 16, 10).cast("bigint")
    wanted = materialize(used.select(F.coalesce(F.concat(F.lit("i"), F.col("low")), F.lit("")).alias("id"), "digest", F.call_function("shiftleft", head, F.lit(64 - 8 * HEAD)).alias("h")), "wanted-texts")
    field = docs.sparkSession.sparkContext.broadcast(bit_field(wanted.select("h")))

    @F.arrow_udf("binary")
    def wanted_digests(texts: pa.Array) -> pa.Array:
        """Digests, null for most texts that no bucket holds: the same Python step, for each other one takes a worker more."""
        found = digests(texts)
        heads = np.array([int.from_bytes(d[:HEAD], "big") << (64 - 8 * HEAD) for d in found.to_pylist()], U64)
        return pa.array([d if ok else None for d, ok in zip(found.to_pylist(), may_hold(field.value, heads), strict=True)], pa.binary())

    rows = _id_and_digest(docs.select("doc_id", "text"), wanted_digests).where("digest is not null").join(wanted.drop("h"), ["id", "digest"])
    once = rows.groupBy(F.col("digest").alias("rep")).agg(F.coalesce(F.min("doc.text"), F.lit("")).alias("text"))
    return once.withColumn("bag", F.arrow_udf(bags, "binary").asNondeterministic()("text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, in the columns of ``docs``: that of the smallest id (a row without an id only where its class has none); of equal rows one."""
    rows, named = _classes(docs.select("doc_id", "text"))
    discard(rows)
    order = F.struct(F.col("low").isNull(), "low", "digest")
    first = named.groupBy("class").agg(F.min_by(F.struct("low", "digest"), order).alias("k"))
    kept = first.select(F.coalesce(F.concat(F.lit("i"), F.col("k.low")), F.lit("")).alias("id"), F.col("k.digest").alias("digest"))
    return _id_and_digest(docs).join(kept, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("doc.*")
