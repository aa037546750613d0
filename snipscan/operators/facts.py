"""Snippets to fact tables: one Python step parses each source, everything after it is columns.

Input: snippet_id, source (and whatever else). ``with_facts`` adds a struct; the functions below it unfold one table each.
A part that isn't asked for isn't sent back from Python.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources that Spark hands to Python at once: they may be wide.
ARROW_ROWS = 1_000
COUNTERS = ["statements", "complexity", "functions", "classes", "async_defs", "calls", "imports", "loops", "branches", "handlers", "lines_total", "lines_blank", "lines_comment", "lines_code", "max_depth", "outlined"]
_KWARG = [("name", pa.string()), ("value", pa.string()), ("path", pa.string())]
_TYPES: dict[str, pa.DataType] = {
    "parsed": pa.bool_(),
    "failed": pa.bool_(),
    "line_kinds": pa.list_(pa.string()),
    "bytes": pa.int64(),
    "counters": pa.struct([(k, pa.int32()) for k in COUNTERS]),
    "calls": pa.list_(pa.struct([("seq", pa.int32()), ("owner", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("canonical", pa.string()), ("display", pa.string()), ("snippet", pa.string()), ("receiver", pa.string()), ("mode", pa.string()), ("args", pa.list_(pa.string())), ("named", pa.map_(pa.string(), pa.string())), ("texts", pa.list_(pa.string())), ("kwargs", pa.list_(pa.struct(_KWARG))), ("local", pa.bool_())])),
    "env": pa.list_(pa.struct([("seq", pa.int32()), ("owner", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("verb", pa.string()), ("target", pa.string()), ("snippet", pa.string())])),
    "imports": pa.list_(pa.struct([("module", pa.string()), ("names", pa.list_(pa.string())), ("alias", pa.string()), ("line", pa.int32()), ("level", pa.int32()), ("deferred", pa.bool_())])),
    "roots": pa.list_(pa.string()),
    "bindings": pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("origin", pa.string()), ("text", pa.string()), ("scope", pa.string()), ("line", pa.int32()), ("depth", pa.int32()), ("rebinds", pa.int32()), ("accumulates", pa.bool_())])),
    "reads": pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32())])),
    "nodes": pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("path", pa.list_(pa.int32())), ("kind", pa.string()), ("label", pa.string()), ("detail", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("depth", pa.int32()), ("last", pa.int32())])),
    "problems": pa.list_(pa.struct([("level", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())])),
}


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_map(t):
        return f"map<{_ddl(t.key_type)},{_ddl(t.item_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in t) + ">"
    return {pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}[t]


def _column(values: list, t: pa.DataType) -> pa.Array:
    """The walk's tuples, lists and dicts as Arrow: each field of all rows at once, which is several times faster than row by row."""
    if pa.types.is_list(t):
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), _column([x for v in values for x in v], t.value_type), type=t)
    if pa.types.is_map(t):
        pairs = [x for v in values for x in v.items()]
        keys, items = (_column([x[k] for x in pairs], u) for k, u in enumerate((t.key_type, t.item_type)))
        return pa.MapArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), keys, items, type=t)
    if pa.types.is_struct(t):
        rows = [tuple(v[f.name] for f in t) if isinstance(v, dict) else v for v in values]
        columns = zip(*rows, strict=True) if rows else [()] * len(t)
        return pa.StructArray.from_arrays([_column(list(c), f.type) for c, f in zip(columns, t, strict=True)], fields=list(t))
    return pa.array(values, t)


def facts_type(parts: tuple[str, ...]) -> str:
    """The type of the struct ``facts`` of some parts."""
    return _ddl(pa.struct([(p, _TYPES[p]) for p in parts]))


def with_facts(snippets: DataFrame, parts: tuple[str, ...] = ("calls", "env"), source: str = "source") -> DataFrame:
    """``snippets`` with the struct ``facts`` of the parts asked for."""
    kind = pa.struct([(p, _TYPES[p]) for p in parts])
    snippets.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    @F.arrow_udf(_ddl(kind))
    def walk(sources: pa.Array) -> pa.Array:
        from snipscan.sources.walker import facts

        return _column([facts(s) for s in sources.to_pylist()], kind)

    return snippets.withColumn("facts", walk.asNondeterministic()(F.col(source)))


def distinct_sources(snippets: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(source_id, source) once for each text, and ``snippets`` with source_id in place of the text: agents run the same code again and again."""
    keyed = snippets.withColumn("source_id", F.sha2(F.coalesce(F.col(source), F.lit("")), 256))
    return keyed.groupBy("source_id").agg(F.first(source).alias("source")), keyed.drop(source)


def unfold(with_parts: DataFrame, part: str, key: str = "snippet_id") -> DataFrame:
    """A row for each element of a part, with the key and its position."""
    return with_parts.select(key, F.posexplode(f"facts.{part}").alias("pos", "_f")).select(key, "pos", "_f.*")
