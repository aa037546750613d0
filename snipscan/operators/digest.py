"""Hits to what a reader is told: scores, bands, summaries, a sentence, rollups. All aggregates are by snippet.

A hit has snippet_id, seq (emission order), line, col, effect, severity (0 info, 1 notable, 2 caution), verb, symbol,
target, note. ``order_hits`` gives ``pos``, on which every tie is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipscan.functions import catalog
from snipscan.functions.text import clip
from snipscan.operators.classify import classify_rows, emissions

#: Weights of the score, pinned to the bands. Fixed values.
CAUTION, NOTABLE, INFO_CAP, KIND, FETCH_RUN, FETCH_WRITE, ENV_SEND, TOP = 30, 10, 12, 12, 15, 8, 10, 100
QUIET = "clock random stdout env".split()


def _index(values: list[str], c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), c).cast("int") - 1


def stage(effect: Column) -> Column:
    return F.element_at(F.create_map(*[x for e, s in catalog.STAGE.items() for x in (F.lit(e), F.lit(s))]), effect)


def bit(effect: Column) -> Column:
    """The effect's bit in a mask."""
    return F.element_at(F.create_map(*[x for i, e in enumerate(catalog.EFFECTS) for x in (F.lit(e), F.lit(1 << i))]), effect)


def dedup_hits(hits: DataFrame) -> DataFrame:
    """The first of the hits of a symbol at a place."""
    first = Window.partitionBy("snippet_id", "line", "col", "symbol").orderBy("seq")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def order_hits(hits: DataFrame) -> DataFrame:
    """``hits`` with ``pos``: their order in the source, equal places in emission order."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("snippet_id").orderBy("line", "col", "seq")))


def _score(cautions: Column, notables: Column, infos: Column, kinds: Column, has) -> Column:
    score = CAUTION * cautions + NOTABLE * notables + F.least(infos, F.lit(INFO_CAP)) + KIND * F.greatest(kinds - 1, F.lit(0))
    return score + F.when(has("net") & (has("process") | has("dynamic")), FETCH_RUN).otherwise(0) + F.when(has("net") & has("fs_write"), FETCH_WRITE).otherwise(0) + F.when(has("env") & has("net"), ENV_SEND).otherwise(0)


def risk(hits: DataFrame) -> DataFrame:
    """snippet_id, risk (0 to 100), worst severity, mask of effects, number of hits."""
    s, mask = F.col("severity"), F.bit_or(bit(F.col("effect")))
    out = hits.groupBy("snippet_id").agg(
        F.count_if(s == 2).alias("c"), F.count_if(s == 1).alias("n"), F.count_if(s == 0).alias("i"),
        F.bit_count(F.coalesce(F.bit_or(F.when(s == 2, bit(F.col("effect")))), F.lit(0))).alias("kinds"), mask.alias("mask"), F.max(s).alias("worst"), F.count("*").alias("hits"),
    )
    has = lambda e: F.col("mask").bitwiseAND(F.lit(1 << catalog.EFFECTS.index(e))) != 0
    score = _score(F.col("c"), F.col("n"), F.col("i"), F.col("kinds"), has)
    return out.select("snippet_id", F.least(score, F.lit(TOP)).cast("int").alias("risk"), "worst", "mask", "hits")


def band(risk: Column, worst: Column) -> Column:
    """The band of attention: the worst severity first, the score within it; null worst means no hit."""
    w = F.coalesce(worst, F.lit(0))
    return F.when(w == 2, F.when(risk >= 60, "read").otherwise("check")).when(w == 1, F.when(risk >= 45, "check").otherwise("routine")).otherwise(F.when(risk >= 15, "routine").otherwise("inert"))


def band_of_score(risk: Column) -> Column:
    return F.when(risk < 10, "inert").when(risk < 30, "routine").when(risk < 60, "check").otherwise("read")


def effect_summary(hits: DataFrame) -> DataFrame:
    """A row for each snippet and effect with its worst severity, hits and rank: cautions first, then as a program runs."""
    by = hits.groupBy("snippet_id", "effect").agg(F.max("severity").alias("severity"), F.count("*").alias("n"))
    order = Window.partitionBy("snippet_id").orderBy((F.col("severity") != 2).cast("int"), stage(F.col("effect")), F.desc("n"), bit(F.col("effect")))
    return by.withColumn("rank", F.row_number().over(order))


def count_targets(hits: DataFrame) -> DataFrame:
    """For each snippet and effect: n distinct targets (hits, if none has a target) and the most frequent one, the first on a tie."""
    by = hits.groupBy("snippet_id", "effect", "target").agg(F.count("*").alias("times"), F.min("pos").alias("first"), F.max("severity").alias("severity"))
    named = F.col("target").isNotNull()
    best = F.min(F.when(named, F.struct((-F.col("times")).alias("less"), "first", "target")))
    return by.groupBy("snippet_id", "effect").agg(
        F.when(F.count_if(named) > 0, F.count_if(named)).otherwise(F.sum("times")).alias("n"), clip(best["target"], 28).alias("thing"), F.min("first").alias("first"), F.max("severity").alias("severity")
    )


def phrase(effect: Column, n: Column, thing: Column) -> Column:
    """What an effect's hits do, in a few words."""
    one = (n == 1) & thing.isNotNull()

    def say(verb: str, single: str, plural: str, quote: str = "", alone: str | None = None) -> Column:
        many = F.when(n == 1, F.lit(single)).otherwise(F.concat(n.cast("string"), F.lit(f" {plural}")))
        return F.when(one, F.concat(F.lit(f"{alone or verb} {quote}"), thing, F.lit(quote))).otherwise(F.concat(F.lit(f"{verb} "), many))

    many = F.when(n == 1, F.lit("code at runtime")).otherwise(F.concat(n.cast("string"), F.lit(" runtime code paths")))
    return (
        F.when(effect == "fs_read", say("reads", "a file", "files"))
        .when(effect == "fs_write", say("writes", "a file", "files"))
        .when(effect == "fs_delete", say("DELETES", "a path", "paths"))
        .when(effect == "net", say("makes", "a network call", "network calls", alone="calls"))
        .when(effect == "process", say("runs", "a command", "commands", "`"))
        .when(effect == "env", "reads the environment")
        .when(effect == "dynamic", F.concat(F.lit("evaluates "), many))
        .when(effect == "stdout", "prints results")
        .when(effect == "random", "uses randomness")
        .when(effect == "clock", "reads the clock")
        .when(effect == "concurrency", "runs work in parallel")
        .when(effect == "compute", F.when(thing.isNotNull(), F.concat(F.lit("computes with "), thing)).otherwise("computes"))
        .when(effect == "exit", "exits the process")
    )


def _phrases() -> Column:
    """The order of a phrase in the sentence, and its text, from a row by snippet and effect."""
    return F.struct((F.col("severity") != 2).cast("int").alias("calm"), stage(F.col("effect")).alias("stage"), F.col("first").alias("first"), (F.col("effect").isin(QUIET) & (F.col("severity") != 2)).alias("quiet"), phrase(F.col("effect"), F.col("n"), F.col("thing")).alias("text"))


def _headline(phrases: Column) -> Column:
    """The phrases of the sentence in their order, all of them; quiet ones only while there are under three."""
    texts = lambda quiet: F.transform(F.filter(phrases, lambda x: x["quiet"] == quiet), lambda x: x["text"])
    main, aside = texts(False), texts(True)
    return F.concat(main, F.slice(aside, 1, F.greatest(F.lit(3) - F.size(main), F.lit(0))))


def _sentence(parts: Column) -> Column:
    more = F.when(F.size(parts) > 4, F.concat(F.lit(" (+"), (F.size(parts) - 4).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(parts, 1, 4), " → "), more)


def synopsis(hits: DataFrame) -> DataFrame:
    """snippet_id, synopsis: at most four phrases, cautions first, then in the order a program runs; quiet effects only while there are under three."""
    told = count_targets(hits).groupBy("snippet_id").agg(F.array_sort(F.collect_list(_phrases())).alias("all"))  # at most one for each effect
    return told.select("snippet_id", _sentence(_headline(F.col("all"))).alias("synopsis"))


def overview(rows: DataFrame, carry: list[str] | None = None, notes: int = 0, once: list[str] | None = None, collect: dict[str, Column] | None = None) -> DataFrame:
    """risk, worst, mask, hits, headline and synopsis of each snippet in one pass, from classified rows that may have a null effect.

    One shuffle by snippet serves the dedup, the order and the three levels of aggregates. ``carry``: columns that are the
    same in all rows of a snippet; ``once``: columns that stand on one of them. ``notes``: also the leading notes, as
    ``event_notes`` has them. ``collect``: arrays of what an expression gives for each row (nulls left out); it may use
    ``pos``, the row's place in the source, and ``any_effect``, which a hit that repeats another at its place keeps too.
    """
    carry, once, collect = carry or [], once or [], collect or {}
    near = rows.repartition("snippet_id")
    again = F.row_number().over(Window.partitionBy("snippet_id", "line", "col", "symbol").orderBy(F.col("effect").isNull(), "seq")) > 1
    pos = F.row_number().over(Window.partitionBy("snippet_id").orderBy("line", "col", "seq"))
    hits = near.withColumns({"_again": again, "pos": pos}).withColumns({"any_effect": F.col("effect"), "effect": F.when(~F.col("_again"), F.col("effect")), "severity": F.when(~F.col("_again"), F.col("severity"))})
    real = F.col("effect").isNotNull()
    same = [*[F.first(c).alias(c) for c in carry], *[F.first(c, ignorenulls=True).alias(c) for c in once]]
    note = F.struct((-F.col("severity")).alias("less"), "line", "pos", "effect", "severity", "verb", "target", "note")
    lists = collect | ({"_notes": F.when(F.col("severity") > 0, note)} if notes else {})
    of = lambda s: F.count_if(F.col("severity") == s)
    gathered = [F.collect_list(e).alias(k) for k, e in lists.items()]
    by = hits.groupBy("snippet_id", "effect", "target").agg(F.count_if(real).alias("times"), F.min("pos").alias("first"), F.max("severity").alias("severity"), of(2).alias("c"), of(1).alias("m"), of(0).alias("i"), *same, *gathered)
    named = F.col("target").isNotNull() & real
    best = F.min(F.when(named, F.struct((-F.col("times")).alias("less"), "first", "target")))
    merged = [F.flatten(F.collect_list(k)).alias(k) for k in lists]
    sums = [F.sum(k).alias(k) for k in "cmi"]
    by = by.groupBy("snippet_id", "effect").agg(F.when(F.count_if(named) > 0, F.count_if(named)).otherwise(F.sum("times")).alias("n"), clip(best["target"], 28).alias("thing"), F.min("first").alias("first"), F.max("severity").alias("severity"), F.sum("times").alias("hits"), *sums, *same, *merged)
    out = by.groupBy("snippet_id").agg(
        F.array_sort(F.collect_list(F.when(real, _phrases()))).alias("_all"), F.coalesce(F.bit_or(F.when(real, bit(F.col("effect")))), F.lit(0)).alias("mask"), F.count_if((F.col("c") > 0) & real).alias("kinds"), F.max("severity").alias("worst"), F.sum("hits").alias("hits"), *sums, *same, *merged,
    )
    has = lambda e: F.col("mask").bitwiseAND(F.lit(1 << catalog.EFFECTS.index(e))) != 0
    score = _score(F.col("c"), F.col("m"), F.col("i"), F.col("kinds"), has)
    told = [F.transform(F.slice(F.array_sort("_notes"), 1, notes), lambda x: F.struct(*[x[k].alias(k) for k in ("effect", "severity", "verb", "target", "line", "note")])).alias("notes")] if notes else []
    headline = _headline(F.col("_all"))
    return out.select("snippet_id", *carry, *once, F.least(score, F.lit(TOP)).cast("int").alias("risk"), "worst", "mask", "hits", headline.alias("headline"), F.when(F.size("_all") > 0, _sentence(headline)).alias("synopsis"), *told, *collect)


def quiet_synopsis(functions: Column, classes: Column, statements: Column) -> Column:
    """The sentence of a snippet without hits."""
    return F.concat(F.lit("no side effects — "), F.array_join(quiet_headline(functions, classes, statements), ", "))


def quiet_headline(functions: Column, classes: Column, statements: Column) -> Column:
    """What a snippet without hits consists of."""
    many = lambda n, one, plural: F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(plural))
    bits = F.filter(F.array(F.when(functions > 0, F.concat(F.lit("defines "), many(functions, "function", "functions"))), F.when(classes > 0, many(classes, "class", "classes"))), lambda x: x.isNotNull())
    return F.when(F.size(bits) > 0, bits).otherwise(F.array(many(statements, "statement", "statements")))


def timeline(hits: DataFrame, limit: int) -> DataFrame:
    """Equal operations folded into their first hit with a count; of more than ``limit`` the worst and most frequent stay. ``rank`` is their order in the source."""
    rest = ["snippet_id", "effect", "verb", "target"]
    folded = hits.groupBy(*rest).agg(F.min_by(F.struct("severity", "line", "col", "symbol", "note", "pos"), "pos").alias("h"), F.count("*").alias("n")).select(*rest, "n", "h.*")
    keep = Window.partitionBy("snippet_id").orderBy(F.desc("severity"), F.desc("n"), "line", "pos")
    shown = folded.withColumn("_k", F.row_number().over(keep)).where(F.col("_k") <= limit).drop("_k")
    return shown.withColumn("rank", F.row_number().over(Window.partitionBy("snippet_id").orderBy("line", "col", "pos")))


def event_notes(hits: DataFrame, limit: int = 4) -> DataFrame:
    """The notable and cautionary hits that an event carries: the worst first, then by line."""
    order = Window.partitionBy("snippet_id").orderBy(F.desc("severity"), "line", "pos")
    return hits.where("severity > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def symbols(rows: DataFrame) -> DataFrame:
    """The inventory of callees by snippet from classified rows that carry ``roots`` (what the snippet imports): uses, lines, origin, effects.

    Noise builtins and methods of no effect are left out; uses of the environment aren't calls.
    """
    symbol, root = F.col("symbol"), F.substring_index("symbol", ".", 1)
    origin = F.when(symbol.startswith("<"), "method").when(~symbol.contains("."), F.when(F.col("local"), "local").otherwise("builtin")).when(F.array_contains("roots", root) | root.isin(catalog.STDLIB), "import").otherwise("method")
    out = rows.where(F.col("display").isNotNull()).groupBy("snippet_id", symbol.alias("canonical")).agg(
        F.min_by("display", "seq").alias("display"), F.max(origin).alias("origin"), F.count("*").alias("count"), F.coalesce(F.bit_or(bit(F.col("effect"))), F.lit(0)).alias("effects"), F.array_sort(F.collect_set("line")).alias("lines"),
    )
    return out.where(~F.col("canonical").isin(catalog.NOISE) & ~((F.col("origin") == "method") & (F.col("effects") == 0)))


def read_bindings(bindings: Column, reads: Column) -> Column:
    """The bindings of a snippet by line and name, with the loads of each name and whether there is none. ``origin`` is the shape of a long expression, ``text`` its beginning."""
    loads = lambda b: F.coalesce(F.get(F.filter(reads, lambda r: r["name"] == b["name"]), F.lit(0))["n"], F.lit(0))
    names = ("name", "kind", "value", "origin", "text", "scope", "line", "depth", "rebinds", "accumulates")
    told = F.transform(bindings, lambda b: F.struct(*[b[k].alias(k) for k in names], loads(b).alias("reads"), (loads(b) == 0).alias("dead")))
    return F.array_sort(told, lambda a, b: F.when(F.struct(a["line"], a["name"]) < F.struct(b["line"], b["name"]), -1).when(F.struct(a["line"], a["name"]) > F.struct(b["line"], b["name"]), 1).otherwise(0))


def _group(symbol: Column, local: Column) -> Column:
    """Where a callee belongs: its module or the kind of value whose method it is."""
    return F.when(symbol.startswith("<"), F.regexp_extract(symbol, r"^<+([^>.]*)", 1)).when(symbol.contains("."), F.regexp_extract(symbol, r"^(.*)\.[^.]*$", 1)).otherwise(F.when(local, "<local>").otherwise("<builtins>"))


def symbol_list(uses: Column, roots: Column) -> Column:
    """The inventory of callees of a snippet from its uses (symbol, seq, display, local, line, bit), in order: by count, then by group and name."""
    names = F.array_distinct(F.transform(uses, lambda u: u["symbol"]))

    def one(name: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(uses, lambda u: u["symbol"] == name), lambda u: F.struct(u["seq"].alias("seq"), u["display"].alias("display"), u["local"].alias("local"), u["line"].alias("line"), u["bit"].alias("bit"))))
        first, root = F.get(own, F.lit(0)), F.substring_index(name, ".", 1)
        origin = F.when(name.startswith("<"), "method").when(~name.contains("."), F.when(first["local"], "local").otherwise("builtin")).when(F.array_contains(roots, root) | root.isin(catalog.STDLIB), "import").otherwise("method")
        effects = F.aggregate(own, F.lit(0), lambda acc, u: acc.bitwiseOR(u["bit"]))
        return F.struct((-F.size(own)).alias("less"), _group(name, first["local"]).alias("group"), name.alias("canonical"), first["display"].alias("display"), origin.alias("origin"), F.size(own).alias("count"), F.array_distinct(F.transform(own, lambda u: u["line"])).alias("lines"), effects.alias("effects"))

    kept = F.filter(F.array_sort(F.transform(names, one)), lambda s: ~s["canonical"].isin(catalog.NOISE) & ~((s["origin"] == "method") & (s["effects"] == 0)))
    return F.transform(kept, lambda s: F.struct(*[s[k].alias(k) for k in ("canonical", "display", "group", "origin", "count", "lines", "effects")]))


def _cell(text: Column) -> dict[str, Column]:
    """What a line looks like: indent (a tab is 4), width, blank, comment."""
    lead = F.regexp_extract(text, r"^[ \t\f\x0b\r]*", 0)
    body = F.btrim(text, F.lit(" \t\r\f\x0b"))
    indent = F.least(F.lit(255), F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))))
    return {"indent": indent, "width": F.length(body), "blank": body == "", "comment": body.startswith("#")}


def line_cells(lines: Column, kinds: Column, hits: Column) -> Column:
    """The texture of a snippet as an array: each line's look, the kind of the first node on it, effects and severity of its hits."""

    def cell(text: Column, i: Column) -> Column:
        on = F.filter(hits, lambda h: h["line"] == i + 1)
        severity = F.get(F.array(*map(F.lit, catalog.SEVERITIES)), F.array_max(F.transform(on, lambda h: h["severity"])))
        return F.struct(*[e.alias(k) for k, e in _cell(text).items()], F.get(kinds, i).alias("kind"), F.aggregate(on, F.lit(0), lambda acc, h: acc.bitwiseOR(bit(h["effect"]))).alias("effects"), severity.alias("severity"))

    shown = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
    return F.transform(shown, cell)


def bindings_of(walked: DataFrame) -> DataFrame:
    """A row for each binding of snippets with the facts ``bindings`` and ``reads``; nothing is shuffled."""
    told = read_bindings(F.col("facts.bindings"), F.col("facts.reads"))
    return walked.select("snippet_id", F.posexplode(told).alias("pos", "_b")).select("snippet_id", "pos", "_b.*")


#: How an outline is drawn: a line that goes on, one that has ended, a child, the last child. Fixed values.
GOES_ON, ENDED, CHILD, LAST_CHILD = "│  ", "   ", "├─ ", "└─ "


def roll_up(nodes: Column, hits: Column) -> Column:
    """The nodes of a snippet with own_effects, and effects, severity and weight of the whole subtree, and the prefix that draws the tree.

    ``hits`` have owner, effect and severity. Ids go down the tree first, so a subtree is the range of ids up to its last.
    """
    bits = lambda some: F.aggregate(some, F.lit(0), lambda acc, h: acc.bitwiseOR(bit(h["effect"])))
    ends = lambda k: F.get(nodes, k)["last"] == F.get(nodes, F.get(nodes, k)["parent_id"])["last"]

    def rolled(n: Column) -> Column:
        own = F.filter(hits, lambda h: h["owner"] == n["node_id"])
        below = F.filter(hits, lambda h: h["owner"].between(n["node_id"], n["last"]))
        above = F.slice(n["path"], 2, F.greatest(F.size(n["path"]) - 2, F.lit(0)))
        drawn = F.concat(F.array_join(F.transform(above, lambda k: F.when(ends(k), ENDED).otherwise(GOES_ON)), ""), F.when(ends(n["node_id"]), LAST_CHILD).otherwise(CHILD))
        return F.struct(
            *[n[k].alias(k) for k in ("node_id", "parent_id", "path", "kind", "label", "detail", "line", "end_line", "depth")], bits(own).alias("own_effects"), bits(below).alias("effects"),
            F.array_max(F.transform(below, lambda h: h["severity"])).alias("severity"), (n["last"] - n["node_id"] + 1).alias("weight"), F.when(n["parent_id"] >= 0, drawn).otherwise("").alias("prefix"),
        )

    return F.transform(nodes, rolled)


def nested(spine: Column, root: Column) -> Column:
    """The rolled-up nodes of a snippet, flat and from the top down, as the JSON of one tree: each node holds its ``children``. ``root`` labels the first.

    A node opens where it stands and closes before the next that isn't below it, so neither depth nor width has a limit.
    """
    level = lambda k: F.coalesce(F.size(F.get(spine, k)["path"]), F.lit(1))

    def text(n: Column, i: Column) -> Column:
        own, following = F.size(n["path"]), F.when(i + 1 < F.size(spine), level(i + 1)).otherwise(1)
        label = F.when(i == 0, root).otherwise(n["label"])
        told = F.to_json(F.struct(n["node_id"].alias("id"), n["kind"].alias("kind"), label.alias("label"), *[n[k].alias(k) for k in ("detail", "line", "end_line", "depth", "own_effects", "effects", "severity", "weight")]), {"ignoreNullFields": "false"})
        comma = F.when((i > 0) & (level(i - 1) >= own), ",").otherwise("")
        return F.concat(comma, F.substring(told, F.lit(1), F.length(told) - 1), F.lit(',"children":['), F.repeat(F.lit("]}"), F.greatest(own - following + 1, F.lit(0))))

    return F.when(F.size(spine) > 0, F.array_join(F.transform(spine, text), ""))


def nodes_of(walked: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """A row for each node of snippets with the facts ``calls``, ``env`` and ``nodes``, rolled up: one walk, one shuffle by snippet."""
    rows = classify_rows(emissions(walked.withColumn("_nodes", F.col("facts.nodes")), once=("_nodes",)), rules)
    hit = F.when(F.col("effect").isNotNull(), F.struct("owner", "effect", "severity"))
    by = rows.groupBy("snippet_id").agg(F.first("_nodes", ignorenulls=True).alias("_nodes"), F.collect_list(hit).alias("_hits"))  # a snippet's own
    return by.select("snippet_id", F.explode(roll_up(F.col("_nodes"), F.col("_hits"))).alias("_n")).select("snippet_id", "_n.*")


def outline(nodes: DataFrame, max_depth: int) -> DataFrame:
    """The rolled-up nodes down to a depth, with how many each of the deepest hides."""
    hidden = F.when(F.col("depth") == max_depth, F.col("weight") - 1).otherwise(0)
    return nodes.where(F.col("depth") <= max_depth).withColumn("hidden", hidden)


def source_lines(snippets: DataFrame, source: str = "source") -> DataFrame:
    """(snippet_id, line, text): split at newlines, without a carriage return before one and without the empty piece after the last."""
    rows = snippets.select("snippet_id", F.posexplode(F.split(F.regexp_replace(F.col(source), r"\n\z", ""), "\n", -1)).alias("_i", "text")).where(F.length(source) > 0)
    return rows.select("snippet_id", (F.col("_i") + 1).alias("line"), F.regexp_replace("text", r"\r\z", "").alias("text"))


def line_counts(snippets: DataFrame, source: str = "source") -> DataFrame:
    """snippet_id, lines_total, lines_code, lines_comment, lines_blank of each snippet, without exploding its lines."""
    text = F.regexp_replace(F.col(source), r"\n\z", "")
    lines = F.when(F.length(source) > 0, F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")))).otherwise(F.array().cast("array<string>"))
    counted = snippets.select("snippet_id", lines.alias("_l"))
    blank, comment = F.size(F.filter("_l", lambda x: x == "")), F.size(F.filter("_l", lambda x: x.startswith("#")))
    return counted.select("snippet_id", F.size("_l").alias("lines_total"), (F.size("_l") - blank - comment).alias("lines_code"), comment.alias("lines_comment"), blank.alias("lines_blank"))


def texture(snippets: DataFrame, hits: DataFrame | None = None, nodes: DataFrame | None = None, source: str = "source") -> DataFrame:
    """A row for each line: indent (a tab is 4), width, blank, comment, and the kind, effects and severity of what stands on it."""
    out = source_lines(snippets, source).select("snippet_id", "line", *[e.alias(k) for k, e in _cell(F.col("text")).items()])
    if nodes is not None:
        out = out.join(nodes.where("kind <> 'module'").groupBy("snippet_id", "line").agg(F.min_by("kind", "node_id").alias("kind")), ["snippet_id", "line"], "left")
    if hits is not None:
        out = out.join(hits.groupBy("snippet_id", "line").agg(F.bit_or(bit(F.col("effect"))).alias("effects"), F.max("severity").alias("severity")), ["snippet_id", "line"], "left").withColumn("effects", F.coalesce("effects", F.lit(0)))
    return out


def minimap(lines: DataFrame, columns: int) -> DataFrame:
    """Lines brought to ``columns`` buckets: the buckets of a line are known from its number, so no range join is needed.

    Bucket k covers lines floor(k*n/columns) up to ceil((k+1)*n/columns), so neighbours may share a line.
    """
    n = F.count("*").over(Window.partitionBy("snippet_id"))
    i = F.col("line") - 1
    cells = F.sequence(F.greatest(F.lit(0), F.floor(i * columns / F.col("_n")) - 1).cast("int"), F.least(F.lit(columns - 1), F.floor((i + 1) * columns / F.col("_n")) + 1).cast("int"))
    spread = lines.withColumn("_n", n).withColumn("cell", F.explode(cells))
    inside = (i >= F.floor(F.col("cell") * F.col("_n") / columns)) & (i < F.ceil((F.col("cell") + 1) * F.col("_n") / columns))
    return spread.where(inside).groupBy("snippet_id", "cell").agg(F.max("indent").alias("indent"), F.count_if(~F.col("blank")).alias("live"), F.max("width").alias("width"))
