"""Commands and tool-call payloads to snippets: table functions over a column, and a join for scripts that stand in files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipscan.functions.text import looks_like_python

#: Largest script that is read, in bytes.
MAX_BYTES = 1 << 20
#: What a tool takes, by its lower-case name. Fixed values.
CODE_TOOLS = "execute_code python run_python ipython code_interpreter python_tool jupyter notebookedit python_repl execute_python".split()
SHELL_TOOLS = "bash terminal shell run_command execute_command sh bashtool run_terminal_cmd execute_bash shell_command run_shell_command exec execute".split()
SKIP_TOOLS = "write edit multiedit read glob grep ls webfetch websearch todowrite task agent askuserquestion str_replace create_file view search list_dir read_file write_file edit_file apply_patch".split()
CODE_KEYS, SHELL_KEYS = "code source python script".split(), "command cmd commandLine args".split()

_FOUND = pa.list_(pa.struct([("source", pa.string()), ("label", pa.string()), ("file", pa.string())]))


_FOUND_DDL = "array<struct<source:string,label:string,file:string>>"


def _structs(found: list[tuple]) -> list[dict]:
    return [dict(zip(("source", "label", "file"), x, strict=True)) for x in found]


def found_in(command: Column, cwd: Column | None = None, depth: int = 1) -> Column:
    """The snippets of a command: an array of (source, label, file). Marked as non-deterministic, so that Spark reads each command once."""

    @F.arrow_udf(_FOUND_DDL)
    def read(texts: pa.Array, folders: pa.Array) -> pa.Array:
        from snipscan.sources.shell import extract

        return pa.array([_structs(extract(c, d, depth)) for c, d in zip(texts.to_pylist(), folders.to_pylist(), strict=True)], _FOUND)

    return read.asNondeterministic()(command, cwd if cwd is not None else F.lit(None).cast("string"))


def found_in_first(commands: Column, cwd: Column) -> Column:
    """The snippets with any text of the first of several commands that has one; null if none has."""

    @F.arrow_udf(_FOUND_DDL)
    def read(lists: pa.Array, folders: pa.Array) -> pa.Array:
        from snipscan.sources.shell import extract

        out = []
        for texts, folder in zip(lists.to_pylist(), folders.to_pylist(), strict=True):
            found = ([f for f in extract(c, folder) if (f[0] or "").strip(" \t\r\n")] for c in texts or [])
            out.append(_structs(next(filter(None, found), [])) or None)
        return pa.array(out, _FOUND)

    return read.asNondeterministic()(commands, cwd)


def argv(args: Column) -> Column:
    """What an interpreter's argument array runs: (code, module, script, stdin)."""

    @F.arrow_udf("struct<code:string,module:string,script:string,stdin:boolean>")
    def read(rows: pa.Array) -> pa.Array:
        from snipscan.sources.shell import classify_argv

        return pa.array([vars(classify_argv(r or [])) for r in rows.to_pylist()], pa.struct([("code", pa.string()), ("module", pa.string()), ("script", pa.string()), ("stdin", pa.bool_())]))

    return read(args)


def extract_all(commands: DataFrame, command: str = "command", cwd: str | None = None, files: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """``commands`` with a row for each snippet: segment (its place), source, label.

    A script's text comes from ``files`` (path, content) by a join; without a match its label says unreadable, over
    MAX_BYTES too large, and its source is empty.
    """
    rest = [F.col(f"`{c}`") for c in commands.columns]
    rows = commands.withColumn("_found", found_in(F.col(command), F.col(cwd) if cwd else None, depth)).select(*rest, F.posexplode("_found").alias("segment", "_f")).select(*rest, "segment", "_f.*")
    if files is None:
        content = F.lit(None).cast("string")
    else:
        rows = rows.join(files.select(F.col("path").alias("_path"), F.col("content").cast("string").alias("_content")), F.col("file") == F.col("_path"), "left")
        content = F.col("_content")
    large = F.octet_length(content) > MAX_BYTES
    label = F.when(F.col("file").isNull(), F.col("label")).when(content.isNull(), F.concat("label", F.lit(" (unreadable)"))).when(large, F.concat("label", F.lit(" (too large)"))).otherwise(F.col("label"))
    source = F.when(F.col("file").isNull(), F.col("source")).when(content.isNull() | large, "").otherwise(content)
    return rows.select(*rest, "segment", source.alias("source"), label.alias("label"))


def first_or_itself(commands: DataFrame, key: str, command: str = "command") -> DataFrame:
    """(key, source, label): the first snippet with any text, or else the input itself."""
    found = extract_all(commands.select(key, command), command).where("trim(source) <> ''").groupBy(key).agg(F.min_by(F.struct("source", "label"), "segment").alias("f"))
    return commands.select(key, command).join(found, key, "left").select(key, F.coalesce("f.source", command).alias("source"), F.coalesce("f.label", F.lit("<stdin>")).alias("label"))


#: What is read of a payload and of a tool's arguments, as text.
PAYLOAD = "tool_name string, tool string, tool_input string, args string, input string, cwd string"
ARGUMENTS = ", ".join(f"{k} string" for k in dict.fromkeys([*CODE_KEYS, *SHELL_KEYS, "cell_type", "new_source"]))


def once(json: Column, schema: str) -> Column:
    """The struct that a JSON text holds, as a row: a generated row isn't merged into what uses it, so the text is parsed once."""
    return F.explode(F.array(F.from_json(json, schema)))


def in_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``payloads`` with a row for each snippet: segment, source, label. The tool's name decides where Python may stand; unknown tools get both readings.

    Payloads that aren't JSON objects have no snippets.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in payloads.columns]).alias("row")
    given = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    full = lambda c: F.when(F.btrim(c, F.lit(" \t\r\n")) != "", c)
    p = payloads.select(row, once(F.col(payload), PAYLOAD).alias("p"))
    args = F.coalesce(*[F.when(F.col(f"p.{n}").startswith("{") & (F.col(f"p.{n}") != "{}"), F.col(f"p.{n}")) for n in ("tool_input", "args", "input")])
    tool = F.btrim(F.coalesce(given("p.tool_name", "p.tool"), F.lit("")))
    p = p.select("row", tool.alias("tool"), F.lower(tool).alias("low"), F.col("p.cwd").alias("cwd"), once(args, ARGUMENTS).alias("a")).where(~F.col("low").isin(SKIP_TOOLS))
    takes_code, takes_shell, notebook = F.col("low").isin(CODE_TOOLS), F.col("low").isin(SHELL_TOOLS), F.col("low") == "notebookedit"
    unknown = ~takes_code & ~takes_shell
    value = lambda k: F.col(f"a.{k}")
    cell = F.when(F.lower(F.coalesce(given("a.cell_type"), F.lit("code"))) == "code", full(given("a.new_source", "a.source")))
    code = F.coalesce(*[F.when(takes_code | looks_like_python(value(k)), full(value(k))) for k in CODE_KEYS])
    spoken = [full(F.when(value(k).startswith("["), F.array_join(F.from_json(value(k), "array<string>"), " ")).otherwise(value(k))) for k in SHELL_KEYS]
    p = p.select("row", "tool", "cwd", notebook.alias("notebook"), F.when(notebook, cell).when(takes_code | unknown, code).alias("code"), F.when(~notebook & (takes_shell | unknown), F.array(*spoken)).alias("spoken"))
    label = F.when(F.col("notebook"), "notebook cell").otherwise(F.when(F.col("tool") != "", F.col("tool")).otherwise("code"))
    direct = F.when(F.col("code").isNotNull(), F.array(F.struct(F.col("code").alias("source"), label.alias("label"), F.lit(None).cast("string").alias("file"))))
    p = p.withColumn("read", found_in_first(F.when(F.col("code").isNull(), F.col("spoken")), F.col("cwd")))
    return p.select("row", F.posexplode(F.coalesce(direct, "read")).alias("segment", "f")).select("row.*", "segment", "f.source", "f.label")


def origin(payload: Column, default: str = "hook") -> Column:
    """Where a payload came from: its source and the start of its session's id."""
    told = F.from_json(payload, "session_id string, hook_source string")
    session = F.substring(F.coalesce(told["session_id"], F.lit("")), 1, 8)
    return F.concat(F.coalesce(F.nullif(told["hook_source"], F.lit("")), F.lit(default)), F.when(session != "", F.concat(F.lit(":"), session)).otherwise(""))
