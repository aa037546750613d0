"""The operators' queries over the driver's tables, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipscan.llm import decontamination, html_blocks, importance, line_dedup, mixing, order_minhash, packing, quality_gam, rule_forest, spotsigs, token_rollup, toxicity_ftrl, whitening
from snipscan.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    gone = F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed"))
    return out.select("doc_id", F.greatest(F.coalesce("_lines", F.lit(0)), F.lit(0)).cast("bigint").alias("n_lines"), gone.cast("bigint").alias("n_removed"), "text")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_gam.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("_text").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint_text(F.col("_own")).alias("fingerprint"),
        spotsigs.fingerprint_text(F.col("_changed")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        spotsigs.likeness(F.col("_own"), F.col("_next__own")).alias("near_next"),
    )


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_ftrl.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op5_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_forest.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"]
    return out.select("doc_id", *[F.col(f"_rules.{c}") for c in names])


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("bigint").alias("n_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.with_draws(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("bigint").alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches load an estimate for each document, two revise it to the count, one takes half of the documents away and one brings them back; each batch is delivered twice."""
    counts = materialize(token_rollup.token_counts(table(spark, sf_dir, "documents")), "token-counts")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    guess = counts.withColumn("tokens", (F.coalesce("tokens", F.lit(0)) + 3).cast("bigint"))
    store = token_rollup.Rollup(spark)
    for k in (0, 1):
        for _ in range(2):
            store.commit(f"load-{k}", token_rollup.inserts(guess.where(batch == k)))
    for k in (0, 1):
        for _ in range(2):
            store.commit(f"revise-{k}", token_rollup.revisions(guess.where(batch == k), counts.where(batch == k)))
    half = counts.where(batch == 0)
    for name, rows in (("away", token_rollup.deletes(half)), ("back", token_rollup.inserts(half))):
        for _ in range(2):
            store.commit(name, rows)
    return store.totals()


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_minhash.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "class_name")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of documents with like fingerprints, through length partitions and the pruned Jaccard."""
    return spotsigs.near_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_gam": op2_quality_gam,
    "op3_spotsigs": op3_spotsigs,
    "op4_toxicity_ftrl": op4_toxicity_ftrl,
    "op5_rule_forest": op5_rule_forest,
    "op6_html_blocks": op6_html_blocks,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_token_rollup": op9_token_rollup,
    "op10_order_minhash": op10_order_minhash,
    "op11_whitening": op11_whitening,
    "op12_importance": op12_importance,
    "op13_decontamination": op13_decontamination,
    "near_fingerprints": near_fingerprints,
}

_STOP = "[" + ", ".join(f"'{w}'" for w in spotsigs.anchors()) + "]"
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_CODE = "cast('0x' || substr(md5({0}), 1, 8) as bigint) - 2147483648"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op13_decontamination": f"""
with d as (
  select row_number() over () as r, doc_id, {_ASCII_WORDS} as w from documents),
b as (
  select coalesce(item_id::varchar, '') as item, {_ASCII_WORDS} as w from benchmark),
bw as (
  select distinct item, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as s from b where len(w) > 0),
dw as (
  select r, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as s
  from d, (select distinct n from bw) where len(w) >= n),
m as (
  select r, i, n, item from dw join bw using (n, s)),
hit as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from m)) group by r),
which as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (r) left join which using (r)
""",
    "op12_importance": f"""
with recursive step(i, k, c) as (
  select i, 0, i::bigint from range(256) r(i) union all
  select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
crc_table as (
  select list(c order by i) as t from step where k = 8),
d as (
  select row_number() over () as r, doc_id, {_ASCII_WORDS} as w from documents),
dw as (
  select r, unnest(w) as w from d),
bw as (
  select unnest({_ASCII_WORDS}) as w from benchmark),
words as (
  select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
bytes(w, x, c) as (
  select w, x, 4294967295 from words union all
  select w, x[3:], xor(t[(xor(c, ('0x' || x[1:2])::bigint) & 255) + 1], c >> 8) from bytes, crc_table where x <> ''),
bucket as (
  select w, xor(c, 4294967295) % 10000 as b from bytes where x = ''),
s as (
  select b, count(*) as s from dw join bucket using (w) group by b),
t as (
  select b, count(*) as t from bw join bucket using (w) group by b),
gain as (
  select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + 10000)::double)))::bigint as g
  from (select distinct b from bucket) left join s using (b) left join t using (b)),
weight as (
  select r, sum(g)::bigint as weight from dw join bucket using (w) join gain using (b) group by r),
score as (
  select d.r, doc_id, len(w) as n, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from d left join weight using (r)),
ranked as (
  select *, row_number() over (partition by n >= 20 order by score desc, doc_id nulls last, r) as k, count(*) filter (n >= 20) over () as fit from score)
select doc_id, n::bigint as n_features, weight::bigint as weight, score::bigint as score, case when n >= 20 and k <= 10 * fit // 100 then k end as rank from ranked
""",
    "op3_spotsigs": f"""
with d as (
  select row_number() over (order by doc_id nulls first, coalesce(text, '')) as r, doc_id, coalesce(text, '') as text from documents),
n as (
  select d.*, coalesce(lead(text) over (order by r), (select text from d where r = 1)) as nxt, coalesce(lead(r) over (order by r), 1) as nr from d),
e as (
  select *, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) as edited from n),
t as (
  select r, 0 as k, text from e union all select r, 1, edited from e),
w as (
  select r, k, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from t),
c as (
  select r, k, w, list_filter(w, lambda x: not list_contains({_STOP}, x)) as c, list_filter(range(1, len(w) + 1), lambda i: list_contains({_STOP}, w[i])) as a from w),
h as (
  select r, k, list_sort(list_distinct(list_concat(
    case when len(w) > 0 then [{_CODE.format("concat_ws(' ', '^', c[1], c[2])")}] else [] end,
    list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda p: p[1] - p[2] + 2 <= len(c)), lambda p: {_CODE.format("w[p[1]] || ' ' || c[p[1] - p[2] + 1] || ' ' || c[p[1] - p[2] + 2]")})))) as s from c),
j as (
  select e.doc_id, e.text, e.edited, o.s as own, x.s as changed, f.s as following from e join h o on o.r = e.r and o.k = 0 join h x on x.r = e.r and x.k = 1 join h f on f.r = e.nr and f.k = 0)
select doc_id, cast(length(text) as bigint) as n_chars, sha256(edited) as edited_sha256, array_to_string(own, ',') as fingerprint, array_to_string(changed, ',') as edited_fingerprint,
  case when len(own) = 0 and len(changed) = 0 then 1.0 else len(list_intersect(own, changed))::double / len(list_distinct(list_concat(own, changed))) end as near_edited,
  case when len(own) = 0 and len(following) = 0 then 1.0 else len(list_intersect(own, following))::double / len(list_distinct(list_concat(own, following))) end as near_next
from j
""",
    "near_fingerprints": f"""
with recursive w as (
  select row_number() over () as r, doc_id, {_WORDS} as w from (select doc_id, coalesce(text, '') as text from documents)),
c as (
  select r, doc_id, w, list_filter(w, lambda x: not list_contains({_STOP}, x)) as c, list_filter(range(1, len(w) + 1), lambda i: list_contains({_STOP}, w[i])) as a from w),
h as (
  select r, doc_id, list_sort(list_distinct(list_concat(
    case when len(w) > 0 then [{_CODE.format("concat_ws(' ', '^', c[1], c[2])")}] else [] end,
    list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda p: p[1] - p[2] + 2 <= len(c)), lambda p: {_CODE.format("w[p[1]] || ' ' || c[p[1] - p[2] + 1] || ' ' || c[p[1] - p[2] + 2]")})))) as s from c),
g as (
  select min(r) as k, s, len(s) as n, min(doc_id) as low from h group by s),
x as (
  select k, n, unnest(s) as i from g),
p as (
  select a.k as a, b.k as b from x a join x b on a.i = b.i and a.k <> b.k and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) group by a.k, a.n, b.k, b.n having count(*) >= 0.8 * (a.n + b.n - count(*))),
t(a, b) as (
  select k, k from g union select t.a, p.b from t join p on t.b = p.a),
m as (
  select t.a as k, min(g.low) as class_id from t join g on t.b = g.k group by t.a)
select h.doc_id, m.class_id from h join g on h.s = g.s join m on m.k = g.k
""",
    "op1_line_dedup": """
with parts as (
  select doc_id, text, coalesce('s' || source, '') as site, string_split(text, chr(10)) as p from documents where doc_id is not null and text is not null),
l as (
  select doc_id, md5(text) as t, site, unnest(p) as raw, generate_subscripts(p, 1) - 1 as pos from parts),
k as (
  select doc_id, t, site, pos, raw, trim(raw, chr(32) || chr(9) || chr(13)) as line from l),
wide as (
  select line, min({'d': doc_id, 't': t, 'p': pos}) as first from k where line <> '' group by line having count(distinct site) >= 5),
marked as (
  select k.*, wide.line is not null and {'d': k.doc_id, 't': k.t, 'p': k.pos} <> wide.first as gone from k left join wide on k.line = wide.line),
edited as (
  select doc_id, t, count(*) as n_lines, sum(gone::int) as n_removed, string_agg(raw, chr(10) order by pos) filter (not gone) as text from marked group by doc_id, t)
select d.doc_id, cast(coalesce(e.n_lines, 0) as bigint) as n_lines, cast(coalesce(e.n_removed, 0) as bigint) as n_removed, case when d.text is null then null else coalesce(e.text, '') end as text
from documents d left join edited e on d.doc_id = e.doc_id and md5(d.text) = e.t
""",
}
