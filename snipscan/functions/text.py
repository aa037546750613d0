"""Scalar functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from snipscan.functions import catalog

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """What ``f`` makes of a value that is worked out once: an expression within a lambda is otherwise evaluated wherever it stands."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """A to Z only; other letters stay as they are."""
    return F.translate(c, _UPPER, _LOWER)


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def clip(c: Column, size: int) -> Column:
    """At most ``size`` characters, cut at a break where there is one in the last third."""
    head = F.substring(c, 1, size - 1)
    word = F.regexp_extract(head, r"(?s)^(.*)[ ,(\[][^ ,(\[]*$", 1)
    cut = F.when(F.length(word) > 2 * (size - 1) // 3, word).otherwise(head)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(cut, F.lit("…")))


def secret_name(name: Column) -> Column:
    """Whether a variable's name says that it holds a secret."""
    low = ascii_lower(name)
    hit = low.endswith("_key") | (low == "key")
    for word in catalog.SECRET_WORDS:
        hit = hit | low.contains(word)
    return hit


def basename(c: Column) -> Column:
    """The command's name without folders and without ``.exe``."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(?i)\.exe$", "")


def is_interpreter(c: Column) -> Column:
    return F.lower(basename(c)).rlike(r"^(python[23]?|pythonw|py|pypy\d*(\.\d+)?|ipython\d*|python3\.\d{1,2})$")


def is_assignment(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*=")


#: Words that open a block, words that alone make a statement, and what may stand before the sign of an assignment. Fixed values.
_OPENERS = "if elif else for while with try except finally".split()
_ALONE = "return raise yield await lambda".split()
_AUGMENTED = ["", *"+ - * / // % ** & | ^ << >>".split()]


def looks_like_python(c: Column) -> Column:
    """A guard for unknown tools: some line begins as a statement does, by its first word or by a sign of assignment."""
    return F.exists(F.split(c, "\n"), _is_statement)


def _is_statement(raw: Column) -> Column:
    line = F.regexp_replace(raw, r"^\s+", "")
    word = F.regexp_extract(line, r"(?U)^\w+", 0)
    rest = line.substr(F.length(word) + 1, F.length(line))
    parts = F.split(F.btrim(rest), r"\s+")  # what follows the first word
    first, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    spaced = rest.rlike(r"^\s")
    called = lambda text: text.rlike(r"(?U)^\w+\s*\(")
    target = F.regexp_extract(line, r"(?U)^[\w.\[\]]+", 0)
    after = F.regexp_replace(line.substr(F.length(target) + 1, F.length(line)), r"^\s+", "")
    given = F.lit(False)
    for sign in (f"{op}=" for op in _AUGMENTED):
        given = given | (after.startswith(sign) & (after.substr(len(sign) + 1, 1) != "="))
    return (
        word.isin(_ALONE)
        | (word.isin(_OPENERS) & rest.rlike(r":\s*(#|$)"))
        | ((word == "import") & spaced & first.rlike(r"(?U)^[\w.]"))
        | ((word == "from") & spaced & first.rlike(r"(?U)^[\w.]+$") & second.rlike(r"^import\b"))
        | ((word == "class") & spaced & first.rlike(r"(?U)^\w"))
        | ((word == "def") & spaced & called(F.btrim(rest)))
        | ((word == "async") & spaced & (first == "def") & called(F.regexp_replace(F.btrim(rest), r"^def\s+", "")))
        | ((word == "print") & rest.rlike(r"^\s*\("))
        | line.rlike(r"(?U)^@\w")
        | ((target != "") & given)
    )


def age_text(ms: Column) -> Column:
    """How long ago, from milliseconds: now, 5s, 3m, 2h."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.when(s <= 1, "now").when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600), F.lit("h")))


def barcode(mask: Column, on: str = "█", off: str = "·") -> Column:
    """One cell for each capability, in groups."""
    cells = []
    for group in catalog.BARCODE.split("|"):
        bits = [F.when(mask.bitwiseAND(F.lit(1 << catalog.EFFECTS.index(e))) != 0, on).otherwise(off) for e in group.split()]
        cells.append(F.concat(*bits))
    return F.concat_ws(" ", *cells)


def band_word(band: Column) -> Column:
    return F.when(band == "check", "check it").when(band == "read", "read it first").otherwise(band)


def band_block(band: Column) -> Column:
    """Three cells, filled by the band's weight."""
    weight = F.when(band == "read", 3).when(band == "check", 2).otherwise(1)
    return F.element_at(F.array(F.lit("█  "), F.lit("██ "), F.lit("███")), weight)


def gate_value(raw: Column) -> Column:
    """A gate setting: off, none, -1 and blank mean none; a number is clamped to 0..100; anything else means none."""
    v = F.lower(F.btrim(raw))
    return F.when(v.isin("", "off", "none", "-1"), None).otherwise(F.when(v.try_cast("int").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), v.try_cast("int")))))


#: Cells of a rising ramp, and ASCII stand-ins for the marks that labels use. Fixed values.
RAMP = "▁▂▃▄▅▆▇█"
MARKS, PLAIN = "…→←—–·•█░", "~><--..#."


def ramp(share: Column) -> Column:
    """The ramp's cell for a share of 0 to 1."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    return F.substring(F.lit(RAMP), (F.floor(s * (len(RAMP) - 1) + 0.5) + 1).cast("int"), F.lit(1))


def meter(share: Column, width: int) -> Column:
    """A bar of ``width`` cells; the empty ones are drawn too."""
    n = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def asciify(c: Column) -> Column:
    return F.translate(c, MARKS, PLAIN)


def call_key(tool: Column, arguments: Column, call_id: Column) -> Column:
    """What names a tool call: its id, or else its tool and the hash of its arguments."""
    return F.when(F.coalesce(call_id, F.lit("")) != "", F.concat(F.lit("id:"), call_id)).otherwise(F.concat(tool, F.lit(":"), F.sha1(arguments.cast("binary"))))
