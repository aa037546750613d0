"""Decisions from scores: gates, warnings, the answer to a harness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipscan.functions import catalog
from snipscan.functions.text import band_word

BANDS = catalog.BANDS


def over(reports: DataFrame, limit: int) -> DataFrame:
    """Snippets riskier than a limit."""
    return reports.where(F.col("risk") > limit)


def decide(events: DataFrame, gate: Column) -> DataFrame:
    """``events`` with ``decision`` (block, approve) and ``answer``: the JSON for one that is blocked. A null gate blocks nothing, 0 all that has a risk."""
    reason = F.concat(F.lit("risk "), F.col("risk").cast("string"), F.lit(" is over the gate of "), gate.cast("string"), F.lit(" — "), F.coalesce("synopsis", F.lit("")))
    blocked = F.coalesce(F.col("risk") > gate, F.lit(False))
    answer = F.to_json(F.struct(F.lit("block").alias("decision"), reason.alias("reason"), F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("ask").alias("permissionDecision"), reason.alias("permissionDecisionReason")).alias("hookSpecificOutput")))
    return events.withColumns({"decision": F.when(blocked, "block").otherwise("approve"), "answer": F.when(blocked, answer)})


def directive(events: DataFrame, gate: Column, mode: str = "approve") -> DataFrame:
    """``events`` with ``directive``: for one over the gate, the JSON that asks a person (``approve``, with the key of a rule that would allow its band from then on) or forbids the call (``block``); else null."""
    told = F.transform("notes", _note_line)
    reason = F.concat(F.lit("risk "), F.col("risk").cast("string"), F.lit(" is over the gate of "), gate.cast("string"), F.lit(" ("), band_word(F.col("band")), F.lit(") — "), F.coalesce(F.nullif("synopsis", F.lit("")), F.lit("see notes")))
    message = F.array_join(F.concat(F.array(reason), told), "\n")
    asked = F.struct(F.lit("approve").alias("action"), message.alias("message"), F.concat(F.lit("snipscan:"), F.col("band")).alias("rule_key"))
    stopped = F.struct(F.lit("block").alias("action"), F.concat(message, F.lit("\n\nTo run it all the same, raise the gate or unset it.")).alias("message"))
    return events.withColumn("directive", F.when(F.coalesce(F.col("risk") > gate, F.lit(False)), F.to_json(asked if mode == "approve" else stopped)))


def wants_warning(band: Column, floor: str) -> Column:
    """Whether a band is at or above the floor; ``never`` warns of nothing."""
    return F.lit(False) if floor == "never" else F.coalesce(band.isin(BANDS[BANDS.index(floor) :]), F.lit(False))


def _note_line(n: Column) -> Column:
    return F.concat(F.lit("  line "), n["line"].cast("string"), F.lit(": "), n["verb"], F.coalesce(F.concat(F.lit(" "), n["target"]), F.lit("")), F.coalesce(F.concat(F.lit(" — "), n["note"]), F.lit("")))


def verdict_text(events: DataFrame) -> DataFrame:
    """``events`` with ``verdict``: band, risk, sentence, and a line for each note."""
    head = F.concat(band_word(F.col("band")), F.lit(" · risk "), F.col("risk").cast("string"), F.lit(" · "), F.col("synopsis"))
    return events.withColumn("verdict", F.array_join(F.concat(F.array(head), F.transform("notes", _note_line)), "\n"))


def take_once(pending: DataFrame, results: DataFrame, key: str = "tool_call_id", wait: str = "10 minutes") -> DataFrame:
    """Calls met by their results, once each: an inner join on the key within a time, where a repeated call or result counts only the first time. Both sides have ``at``; works on streams too."""
    p = _first(pending.withColumnRenamed("at", "asked").withWatermark("asked", wait), key, "asked").alias("p")
    r = _first(results.withColumnRenamed("at", "answered").withWatermark("answered", wait), key, "answered").alias("r")
    near = F.expr(f"answered >= asked AND answered <= asked + interval {wait}")
    return p.join(r, (F.col(f"p.{key}") == F.col(f"r.{key}")) & near).drop(F.col(f"r.{key}"))


def _first(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The first row of each key; in a stream, the first to come within the watermark."""
    if rows.isStreaming:
        return rows.dropDuplicatesWithinWatermark([key])
    order = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
