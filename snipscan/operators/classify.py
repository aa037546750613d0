"""Calls to effect hits: joins with the small catalogue tables, then expressions.

Order of precedence: ``open`` by its mode, an exact rule, a telling method, a numeric package. Our own catalogue tables have
a few hundred rows and are broadcast; for a table that the caller brings Spark decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipscan.functions import catalog
from snipscan.functions.text import ascii_lower, secret_name

INFO, NOTABLE, CAUTION = 0, 1, 2
#: Effects that a hazardous string makes worse. Fixed values.
WORLDLY = "process fs_read fs_write fs_delete net dynamic".split()
_SECRET = "reads a secret from the environment"


def hazards(texts: Column) -> Column:
    """Distinct reasons that a call's own strings give, in the order of its arguments and of the catalogue."""
    found = F.transform(F.transform(texts, ascii_lower), lambda t: F.filter(F.array(*[F.when(t.contains(n), F.lit(why)) for n, why in catalog.HAZARDS.items()]), lambda x: x.isNotNull()))
    return F.array_distinct(F.flatten(found))


def keyword_hazards(canonical: Column, kwargs: Column) -> Column:
    """(note, severity, new effect) of each keyword argument that changes what the call does, in order. Keywords, calls and notes are fixed values."""
    http = canonical.rlike(r"^(requests|httpx|<session>|aiohttp|urllib3)\.")
    process = canonical.startswith("subprocess.") | canonical.startswith("asyncio.create_subprocess")

    def said(note: str, severity: int, effect: str | None = None) -> Column:
        return F.struct(F.lit(note).alias("note"), F.lit(severity).alias("severity"), F.lit(effect).cast("string").alias("effect"))

    def judge(k: Column) -> Column:
        name, value = k["name"], k["value"]
        true, false, open_ = value == "true", value == "false", value.isin("path", "other")
        loader = (value == "path") & k["path"].endswith("Loader") & ~k["path"].endswith("SafeLoader")
        return (
            F.when((name == "shell") & process & true, said("shell=True — the argument is interpreted by /bin/sh", CAUTION))
            .when((name == "shell") & process & open_, said("shell=… — decided at runtime; may go through /bin/sh", NOTABLE))
            .when((name == "check") & process & false, said("check=False — a failing command is ignored", NOTABLE))
            .when((name == "verify") & http & false, said("verify=False — TLS certificates are not checked", CAUTION))
            .when((name == "verify") & http & open_, said("verify=… — decided at runtime; TLS checking may be off", NOTABLE))
            .when((name == "allow_pickle") & (canonical == "numpy.load") & ~false, said("allow_pickle=True — loading can run arbitrary code", CAUTION, "dynamic"))
            .when((name == "weights_only") & (canonical == "torch.load") & false, said("weights_only=False — torch.load will unpickle arbitrary objects", CAUTION))
            .when((name == "trust_remote_code") & ~false, said("trust_remote_code=True — runs code shipped with the download", CAUTION, "dynamic"))
            .when((name == "Loader") & canonical.startswith("yaml.") & loader, said("Loader=yaml.Loader — can construct arbitrary Python objects", CAUTION, "dynamic"))
            .when((name == "ignore_errors") & true, said("ignore_errors=True — failures pass silently", NOTABLE))
            .when((name == "preexec_fn") & process, said("preexec_fn — runs a callable in the child before exec", NOTABLE))
        )

    return F.filter(F.transform(kwargs, judge), lambda x: x.isNotNull())


def argument(spec: Column, args: Column, named: Column) -> Column:
    """The argument that a target spec names: ``-``, a position, or ``name/position``."""
    place = F.get(args, F.substring_index(spec, "/", -1).try_cast("int"))
    return F.when(spec == "-", None).when(spec.contains("/"), F.coalesce(F.try_element_at(named, F.substring_index(spec, "/", 1)), place)).otherwise(place)


def _table(df: DataFrame, key: str, prefix: str, small: bool = True) -> DataFrame:
    severity = F.array_position(F.array(*map(F.lit, catalog.SEVERITIES)), F.col("severity")).cast("int") - 1
    out = df.select(F.col("path").alias(key), F.struct("effect", severity.alias("severity"), "verb", "target", "note").alias(prefix))
    return F.broadcast(out) if small else out


def with_rules(calls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``calls`` with the structs ``rule`` (exact), ``method`` (by last name, where there is no rule) and ``compute`` (the root of a numeric package)."""
    spark = calls.sparkSession
    out = calls.join(_table(rules if rules is not None else catalog.rule_table(spark), "_path", "rule", rules is None), F.col("canonical") == F.col("_path"), "left").drop("_path")
    dotted = F.col("canonical").contains(".") & ~F.col("canonical").startswith("<")
    out = out.withColumn("_method", F.when(F.col("rule").isNull() & dotted, F.substring_index("canonical", ".", -1)))
    out = out.join(_table(catalog.method_table(spark), "_name", "method"), F.col("_method") == F.col("_name"), "left").drop("_name", "_method")
    root = F.substring_index("canonical", ".", 1)
    return out.withColumn("compute", F.when(F.col("rule").isNull() & F.col("method").isNull() & F.col("canonical").contains(".") & root.isin(catalog.COMPUTE), root))


_NO_CALL = {"display": "string", "receiver": "string", "mode": "string", "args": "array<string>", "named": "map<string,string>", "texts": "array<string>", "kwargs": "array<struct<name:string,value:string,path:string>>", "local": "boolean"}
_PLACE = ["seq", "owner", "line", "col"]


def emissions(walked: DataFrame, *carry: str, once: tuple[str, ...] = ()) -> DataFrame:
    """A row for each call and each use of the environment, with the columns to carry; a snippet with none keeps one row of nulls.

    One explode of one struct: the sources are walked once, however many results are made of the rows. Columns of ``once``
    may be wide: they stand on the first row of each snippet alone.
    """
    call = lambda c: F.struct(*[c[k].alias(k) for k in (*_PLACE, "canonical", "snippet", *_NO_CALL)], F.lit(None).cast("string").alias("env_verb"), F.lit(None).cast("string").alias("env_target"))
    use = lambda e: F.struct(*[e[k].alias(k) for k in _PLACE], F.when(e["verb"] == "argv", "sys.argv").otherwise("os.environ").alias("canonical"), e["snippet"].alias("snippet"), *[F.lit(None).cast(t).alias(k) for k, t in _NO_CALL.items()], e["verb"].alias("env_verb"), e["target"].alias("env_target"))
    both = F.concat(F.transform("facts.calls", call), F.transform("facts.env", use))
    names = [c.rsplit(".", 1)[-1] for c in carry]
    if not once:
        return walked.select("snippet_id", *carry, F.explode_outer(both).alias("_f")).select("snippet_id", *names, "_f.*")
    rows = walked.select("snippet_id", *carry, *once, F.posexplode_outer(both).alias("_p", "_f"))
    return rows.select("snippet_id", *names, *[F.when(F.coalesce("_p", F.lit(0)) == 0, F.col(c)).alias(c) for c in once], "_f.*")


def classify_rows(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``rows`` of ``emissions`` with effect (null: none), severity, verb, symbol, target and note; other columns stay."""
    use = F.col("env_verb").isNotNull()
    c = with_rules(rows, rules).withColumns({"_hazards": F.when(F.col("texts").isNotNull(), hazards(F.col("texts"))).otherwise(F.array().cast("array<string>")), "_open": ~use & F.col("canonical").isin("open", "io.open")})
    mode = F.coalesce("mode", F.lit("r"))
    opened = F.when(mode.contains("w"), "truncate").when(mode.contains("a"), "append").when(mode.contains("x"), "create").when(mode.contains("+"), "update").otherwise("read")
    none = F.array().cast("array<struct<note:string,severity:int,effect:string>>")
    c = c.withColumns({"_base": F.when(~use, F.coalesce("rule", "method")), "_verb": F.when(F.col("_open"), opened)})
    c = c.withColumn("_kw", F.when(F.col("rule").isNotNull() & F.col("kwargs").isNotNull(), keyword_hazards(F.col("canonical"), F.col("kwargs"))).otherwise(none))
    target = (
        F.when(use, F.col("env_target"))
        .when(F.col("_open"), argument(F.lit("file/0"), F.col("args"), F.col("named")))
        .when(F.col("_base").isNotNull(), F.coalesce(argument(F.col("_base.target"), F.col("args"), F.col("named")), F.col("receiver")))
        .otherwise(F.col("compute"))
    )
    c = c.withColumn("_target", target)
    changed = F.get(F.reverse(F.filter(F.transform("_kw", lambda k: k["effect"]), lambda e: e.isNotNull())), F.lit(0))
    effect = F.when(use, "env").when(F.col("_open"), F.when(F.col("_verb") == "read", "fs_read").otherwise("fs_write")).when(F.col("_base").isNotNull(), F.coalesce(changed, F.col("_base.effect"))).when(F.col("compute").isNotNull(), "compute")
    alarmed = (F.size("_hazards") > 0) & F.coalesce(F.col("_open") | F.col("_base.effect").isin(WORLDLY), F.lit(False))
    read = F.when(use, F.col("env_verb") == "getenv").otherwise((effect == "env") & F.col("rule.verb").isin("getenv", "dotenv"))
    secret = F.coalesce(read & secret_name(F.col("_target")), F.lit(False))
    own = F.when(use, F.when(F.col("env_verb") == "argv", INFO).otherwise(NOTABLE)).when(F.col("_open"), F.when(F.col("_verb") == "read", INFO).otherwise(NOTABLE)).otherwise(F.coalesce("_base.severity", F.lit(INFO)))
    severity = F.greatest(own, F.when(alarmed, CAUTION).otherwise(INFO), F.coalesce(F.array_max(F.transform("_kw", lambda k: k["severity"])), F.lit(INFO)), F.when(secret, CAUTION).otherwise(INFO))
    notes = F.concat(
        F.array(F.when(~F.col("_open"), F.col("_base.note"))),
        F.when(alarmed, F.col("_hazards")).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_open"), F.array().cast("array<string>")).otherwise(F.transform("_kw", lambda k: k["note"])),
        F.array(F.when(secret, F.lit(_SECRET))),
    )
    notes = F.filter(notes, lambda n: n.isNotNull())
    made = {"effect": effect, "severity": F.when(effect.isNotNull(), severity).cast("int"), "verb": F.when(effect.isNotNull(), F.coalesce("env_verb", "_verb", "_base.verb", F.lit("compute"))), "symbol": F.col("canonical"), "target": F.col("_target"), "note": F.when(F.size(notes) > 0, F.array_join(notes, "; "))}
    used = {"canonical", "receiver", "mode", "args", "named", "texts", "kwargs", "env_verb", "env_target"}
    return c.select(*[k for k in rows.columns if k not in used], *[v.alias(k) for k, v in made.items()])


def classify_calls(calls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """A hit for each of the calls that has an effect."""
    rows = calls.withColumns({"env_verb": F.lit(None).cast("string"), "env_target": F.lit(None).cast("string")})
    return classify_rows(rows, rules).where("effect is not null")


def classify(walked: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """All hits of snippets with the facts ``calls`` and ``env``."""
    return classify_rows(emissions(walked), rules).where("effect is not null")


def third_party(imports: DataFrame) -> DataFrame:
    """``imports`` with ``third_party``: not relative, and its root isn't of the standard library."""
    return imports.withColumn("third_party", (F.col("level") == 0) & ~F.substring_index("module", ".", 1).isin(catalog.STDLIB))
