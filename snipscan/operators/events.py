"""Reports and events of snippets, and what a session of events adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipscan.functions import catalog
from snipscan.functions.text import age_text, band_block, barcode
from snipscan.operators import digest
from snipscan.operators.classify import classify_rows, emissions
from snipscan.operators.facts import COUNTERS, distinct_sources, with_facts

SCHEMA = 1
BANDS = catalog.BANDS


def severity_name(s: Column) -> Column:
    return F.get(F.array(*map(F.lit, catalog.SEVERITIES)), s)


FAILED = "analysis failed — read it yourself"


def _calm(failed: Column, of: str = "") -> Column:
    """The sentence of a snippet without hits, from its counters under ``of``."""
    n = lambda k: F.col(of + k)
    return F.when(failed, FAILED).when(n("lines_total") == n("lines_blank"), "nothing to run").otherwise(digest.quiet_synopsis(n("functions"), n("classes"), n("outlined")))


REPORT_PARTS = ("parsed", "failed", "bytes", "counters", "calls", "env")


def reports(snippets: DataFrame, rules: DataFrame | None = None, walked: DataFrame | None = None) -> DataFrame:
    """One row for each snippet: parsed, bytes, line and node counts, risk, worst, band, mask, synopsis. One walk, one shuffle.

    ``walked`` are the snippets with REPORT_PARTS already told, as a ``FactStore`` gives them; then nothing is walked.
    """
    walked = with_facts(snippets, REPORT_PARTS) if walked is None else walked
    rows = classify_rows(emissions(walked, "facts.parsed", "facts.failed", "facts.bytes", "facts.counters"), rules)
    r = digest.overview(rows, ["parsed", "failed", "bytes", "counters"]).select("snippet_id", "parsed", "failed", "bytes", "counters.*", "risk", "worst", "mask", "hits", "synopsis")
    return r.withColumns({"band": digest.band(F.col("risk"), F.col("worst")), "synopsis": F.coalesce("synopsis", _calm(F.col("failed"))), "worst": severity_name(F.col("worst"))}).drop("outlined")


def reports_once(snippets: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """As ``reports``, at the cost of the distinct sources: each is walked, classified and summed up once, and its report joined to its snippets."""
    texts, keyed = distinct_sources(snippets.select("snippet_id", "source"))
    told = reports(texts.withColumnRenamed("source_id", "snippet_id"), rules).withColumnRenamed("snippet_id", "_of")
    return keyed.join(told, F.col("source_id") == F.col("_of")).drop("source_id", "_of")


def events(snippets: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Snippets (snippet_id, ts, name, origin, source) condensed to feed events with at most four notes."""
    walked = with_facts(snippets, ("failed", "counters", "calls", "env"))
    rows = classify_rows(emissions(walked, "ts", "name", "origin", "facts.failed", "facts.counters"), rules)
    e = digest.overview(rows, ["ts", "name", "origin", "failed", "counters"], notes=4).select("*", "counters.*")
    notes = F.transform("notes", lambda n: F.struct(n["effect"].alias("effect"), severity_name(n["severity"]).alias("severity"), n["verb"].alias("verb"), n["target"].alias("target"), n["line"].alias("line"), n["note"].alias("note")))
    return e.select(
        F.lit(SCHEMA).alias("schema"), "ts", "name", F.col("origin").alias("source"), F.col("lines_total").alias("lines"), "risk", digest.band(F.col("risk"), F.col("worst")).alias("band"), "mask",
        severity_name(F.col("worst")).alias("worst"), F.coalesce("synopsis", _calm(F.col("failed"))).alias("synopsis"), notes.alias("notes"), F.lit(False).alias("blocked"),
    )


#: What the walk has to tell for each column of a dossier, beyond what all of them take.
_PARTS_OF = {
    "source": (), "parsed": ("parsed",), "failed": (), "bytes": ("bytes",), "metrics": (), "effects": (), "symbols": ("roots",), "imports": ("imports",), "bindings": ("bindings", "reads"), "spine": ("nodes",), "texture": ("line_kinds",), "diagnostics": ("problems",),
}
_ALWAYS = ("failed", "counters")
_KEPT = [*_ALWAYS, *[p for parts in _PARTS_OF.values() for p in parts]]
_PARTS = ("calls", "env", *_KEPT)


def dossiers(snippets: DataFrame, rules: DataFrame | None = None, source: str = "source", want: set[str] | None = None) -> DataFrame:
    """Everything known of each snippet in one row: one walk, one shuffle by snippet, and arrays of its own parts.

    snippet_id, source (an array of lines), parsed, failed, bytes, risk, band, worst, mask, headline, synopsis, metrics,
    effects, symbols, imports, bindings, spine, texture, diagnostics. Wide parts travel on one row of each snippet. With
    ``want`` only these of the columns that have parts of their own are told, and what the others take isn't carried along.
    """
    some = _PARTS_OF.keys() if want is None else want
    parts_kept = [*_ALWAYS, *[p for k, parts in _PARTS_OF.items() if k in some for p in parts]]
    walked = with_facts(snippets, ("calls", "env", *parts_kept), source)
    text_kept = [F.col(source).alias("source")] if {"source", "texture"} & set(some) else []
    parts = F.struct(*text_kept, *[F.col(f"facts.{p}").alias(p) for p in parts_kept])
    rows = classify_rows(emissions(walked.select("snippet_id", "facts", parts.alias("_kept")), once=("_kept",)), rules)
    hit = F.when(F.col("effect").isNotNull(), F.struct("pos", "owner", "effect", "severity", "verb", "symbol", "target", "line", "col", "snippet", "note"))
    use = F.when(F.col("display").isNotNull(), F.struct("symbol", "seq", "display", "local", "line", F.coalesce(digest.bit(F.col("any_effect")), F.lit(0)).alias("bit")))
    o = digest.overview(rows, once=["_kept"], collect={"_hits": hit, "_uses": use})
    o = o.select("snippet_id", "risk", F.col("worst").alias("_worst"), "mask", "headline", "synopsis", F.array_sort("_hits").alias("_hits"), F.array_sort("_uses").alias("_uses"), "_kept")
    kept, count = lambda k: F.col(f"_kept.{k}"), lambda k: F.col(f"_kept.counters.{k}")
    text = F.regexp_replace(kept("source"), r"\n\z", "")
    lines = F.when(F.length(kept("source")) > 0, F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))).otherwise(F.array().cast("array<string>"))
    blank = kept("failed") | (count("lines_total") == count("lines_blank"))
    calm = F.when(blank, F.array().cast("array<string>")).otherwise(digest.quiet_headline(count("functions"), count("classes"), count("outlined")))
    third = lambda i: (i["level"] == 0) & ~F.substring_index(i["module"], ".", 1).isin(catalog.STDLIB)
    found = {
        "source": lines,
        "band": digest.band(F.col("risk"), F.col("_worst")),
        "worst": severity_name(F.col("_worst")),
        "headline": F.when(F.size("headline") > 0, F.col("headline")).otherwise(calm),
        "synopsis": F.coalesce("synopsis", _calm(kept("failed"), "_kept.counters.")),
        "metrics": F.struct(*[count(k).alias(k) for k in COUNTERS if k != "outlined"], "risk"),
        "effects": F.transform("_hits", lambda h: F.struct(*[h[k].alias(k) for k in ("effect",)], severity_name(h["severity"]).alias("severity"), *[h[k].alias(k) for k in ("verb", "symbol", "target", "line", "col", "snippet", "note")])),
        "symbols": digest.symbol_list(F.col("_uses"), kept("roots")),
        "imports": F.transform(kept("imports"), lambda i: F.struct(i["module"].alias("module"), i["names"].alias("names"), i["alias"].alias("alias"), i["line"].alias("line"), third(i).alias("third_party"), i["deferred"].alias("deferred"))),
        "bindings": digest.read_bindings(kept("bindings"), kept("reads")),
        "spine": F.transform(digest.roll_up(kept("nodes"), F.col("_hits")), lambda n: n.withField("severity", severity_name(n["severity"]))),
        "texture": digest.line_cells(lines, kept("line_kinds"), F.col("_hits")),
        "diagnostics": kept("problems"),
    }
    own = {"parsed": kept("parsed"), "failed": kept("failed"), "bytes": kept("bytes"), "risk": F.col("risk"), "mask": F.col("mask"), **found}
    return o.select("snippet_id", *[e.alias(k) for k, e in own.items() if k in some or k not in _PARTS_OF])


def documents(snippets: DataFrame, rules: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """(snippet_id, report): everything known of each snippet as one JSON document, in the nested form of a single report."""
    named = snippets.select("snippet_id", F.coalesce(F.col(name) if name else F.lit(None), F.lit("<snippet>")).alias("_name"), "source")
    d = dossiers(named.withColumn("snippet_id", F.struct("snippet_id", "_name")), rules)
    d = d.select("*", F.col("snippet_id._name").alias("_name")).withColumn("bindings", F.transform("bindings", lambda b: b.dropFields("text")))
    as_text = lambda *parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    meta = as_text(F.col("_name").alias("name"), "bytes", "parsed", "synopsis", "headline")
    tree = F.coalesce(digest.nested(F.col("spine"), F.col("_name")), F.lit("null"))
    rest = F.substring(as_text("imports", "effects", "symbols", "bindings", "metrics", "texture", "diagnostics", "source"), F.lit(2), F.lit(2**31 - 1))
    return d.select("snippet_id.snippet_id", F.concat(F.lit(f'{{"schema":{SCHEMA},"meta":'), meta, F.lit(',"spine":'), tree, F.lit(","), rest).alias("report"))


def totals() -> list[Column]:
    """Aggregates of a session: events, blocked, bands, capabilities."""
    bands = [F.count_if(F.col("band") == b).alias(f"band_{b}") for b in BANDS]
    caps = [F.count_if(F.col("mask").bitwiseAND(F.lit(1 << catalog.EFFECTS.index(e))) != 0).alias(f"cap_{e}") for e in catalog.BARCODE.replace("|", "").split()]
    return [F.count("*").alias("events"), F.count_if("blocked").alias("blocked"), *bands, *caps, F.count_if(F.col("band").isin("check", "read")).alias("flagged")]


def session_stats(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(*totals())


def rolled_stats(events: DataFrame, *keys: str) -> DataFrame:
    """``session_stats`` at each level of ``keys``, from all of them to none, with ``level``: how many keys count. One pass, summed up before the shuffle."""
    level = F.lit(len(keys)) - F.bit_count(F.grouping_id())
    return events.rollup(*keys).agg(level.cast("int").alias("level"), *totals())


#: log2 of a sketch's registers. The relative standard error is 1.04 / 2**(SKETCH / 2): 1.6 %.
SKETCH = 12


def sketched(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, events, sketch) of the distinct sources of each group: a few kB each, whatever the number of sources, to be kept and merged."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.hll_sketch_agg("source", F.lit(SKETCH)).alias("sketch"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Groups of ``sketched``, joined to larger ones: (keys, events, sources), ``sources`` an estimate. The events aren't read again."""
    return sketches.groupBy(*keys).agg(F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sources"))


def rate_per_minute(events: DataFrame, *keys: str) -> DataFrame:
    """Events a minute between the first and the last to arrive (``seq``); null for under two events or a second. A first time of 0 counts as unset."""
    e = events.groupBy(*keys).agg(F.count("*").alias("events"), F.min_by("ts", F.when(F.col("ts") != 0, F.col("seq"))).alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"))
    span = F.greatest(F.col("last_ts") - F.coalesce("first_ts", F.lit(0)), F.lit(0))
    return e.select(*keys, "events", F.when((F.col("events") >= 2) & (span >= 1000), F.col("events") * 60000.0 / span).alias("per_minute"))


def recent(events: DataFrame, n: int = 240, *keys: str) -> DataFrame:
    """The last ``n`` events by arrival in each group, oldest first by ``rank``."""
    late = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(late)).where(F.col("rank") <= n)


def latest(events: DataFrame, n: int, prefix: str | None = None) -> DataFrame:
    """The ``n`` newest events of sources that start with a prefix: a top-k, no full sort."""
    chosen = events.where(F.col("source").startswith(prefix)) if prefix else events
    return chosen.orderBy(F.desc("seq")).limit(n)


def read_index(lines: DataFrame, n: int = 50, text: str = "value") -> DataFrame:
    """The ``n`` newest cards of an index of JSON objects, one a line in order of ``seq``, as (seq, row: a variant), newest first; lines that aren't objects are passed over."""
    row = F.try_parse_json(text)
    return lines.select("seq", row.alias("row")).where(F.schema_of_variant("row").startswith("OBJECT")).orderBy(F.desc("seq")).limit(n)


def at_least(events: DataFrame, floor: str) -> DataFrame:
    """Events of a band or a higher one."""
    return events.where(F.col("band").isin(BANDS[BANDS.index(floor) :]))


def worst_of(events: DataFrame, *keys: str, by_band: bool = False) -> DataFrame:
    """Of each group, the event of the greatest risk, the first on a tie; ``by_band``: of equal risk the one of the higher band."""
    band = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    order = F.struct("risk", *([band.alias("band")] if by_band else []), (-F.col("seq")).alias("early"))
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), order).alias("e")).select(*keys, "e.*")


def feed_rows(events: DataFrame, now: Column) -> DataFrame:
    """Each event as a line of text, and a second row for the leading caution of one worth a look."""
    main = F.concat_ws(" ", F.lpad(age_text(now - F.col("ts")), 4, " "), band_block(F.col("band")), F.lpad(F.col("risk").cast("string"), 3, " "), barcode(F.col("mask")), F.col("name"), F.col("synopsis"))
    first = F.get("notes", F.lit(0))
    note = F.when(F.col("band").isin("check", "read") & (first["severity"] == "caution"), F.concat(F.lit("     └ line "), first["line"].cast("string"), F.lit(": "), F.coalesce(first["note"], first["verb"])))
    return events.select("seq", F.posexplode(F.filter(F.array(main, note), lambda x: x.isNotNull())).alias("part", "text"))
