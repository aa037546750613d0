"""The shape of the plans: how often sources are walked, how often rows move, what is read."""

from __future__ import annotations

import re

from snipscan.operators import events
from snipscan.plans.corpus import made_events, snippets
from snipscan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(text: str, what: str) -> int:
    return len(re.findall(what, text))


def test_reports_walk_once_and_shuffle_once(spark):
    for df in (events.reports(snippets(spark, SF)), events.events(snippets(spark, SF))):
        text = plan(df)
        assert count(text, r"ArrowEvalPython") == 1
        assert count(text, r"Exchange hashpartitioning") == 1 and count(text, r"SinglePartition") == 0
        assert count(text, r"BroadcastHashJoin") == 2 and count(text, r"SortMergeJoin|NestedLoop|Cartesian") == 0


def test_each_source_is_walked_once_however_much_is_made_of_it(spark):
    for name in ("subtree_rollup", "outline_fold", "bindings_dead", "report_documents", "whole_pages", "symbol_inventory", "contact_sheet", "extract_commands", "payload_route"):
        text = plan(QUERIES[name](spark, SF))
        assert count(text, r"ArrowEvalPython") == 1, name
        assert count(text, r"Exchange hashpartitioning") <= 1, name


def test_lines_of_json_are_parsed_once(spark):
    assert count(plan(QUERIES["feed_parse"](spark, SF)), r"from_json") == 1
    text = plan(QUERIES["payload_route"](spark, SF))
    assert count(text, r"from_json\(StructField\(tool_name") == 1 and count(text, r"from_json\(StructField\(code") == 1 and count(text, "get_json_object") == 0


def test_only_needed_columns_are_read(spark):
    text = plan(events.at_least(made_events(spark, SF), "check").select("seq"))
    assert "ReadSchema: struct<event_id:bigint>" in text
    text = plan(QUERIES["hazard_scan"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_group_limits_come_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["recent_240"](spark, SF))


def test_totals_combine_before_the_shuffle(spark):
    text = plan(QUERIES["session_stats"](spark, SF))
    assert count(text, "partial_count") and count(text, r"Exchange hashpartitioning") == 1


def test_no_window_over_a_whole_table(spark):
    for name in ("hit_dedup", "effect_summary", "timeline_topk", "event_notes_top4", "recent_240", "card_files", "texture_lines", "minimap"):
        assert "SinglePartition" not in plan(QUERIES[name](spark, SF)), name


def test_only_what_a_page_shows_is_told(spark):
    """Cards need no tree, no bindings and no source; a panel is drawn once for all layouts, a page escaped before its themes."""
    text = plan(QUERIES["contact_sheet"](spark, SF))
    assert not re.search(r"_kept[^\n]*(nodes|bindings|line_kinds|problems)", text)
    assert count(text, "&quot;") == 1 and count(text, "×") <= 4
    assert events.dossiers(snippets(spark, SF), want={"effects"}).columns == ["snippet_id", "risk", "mask", "band", "worst", "headline", "synopsis", "effects"]


def test_texts_are_lowered_once(spark):
    """A call's strings are lowered once, not for each hazard."""
    assert count(plan(QUERIES["snippet_hits"](spark, SF)), r"translate\(lambda") == 1
