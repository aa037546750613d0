"""One snippet's syntax tree as flat facts. A small helper for the tasks of ``snipscan.operators.facts``; classification is joins.

The walk goes in evaluation order and keeps what names mean at each point: imports, constants, what a call returned, and
which names a scope binds itself. It records each call with its canonical path, and says nothing about effects.
"""

from __future__ import annotations

import ast
import re
import warnings

from snipscan.functions.catalog import produces, prefixes, rules
from snipscan.functions.labels import brief, clip, operator, parameters, squeeze

TARGET, SNIPPET, DISPLAY, LABEL, ORIGIN = 44, 72, 32, 64, 40
EXPRESSIONS_DEEP, STATEMENTS_DEEP, FUEL = 256, 96, 64
PRODUCES, PREFIX = produces(), prefixes()
KIND_OF = {v: k for k, v in PREFIX.items()}
KNOWN = frozenset(r[0] for r in rules())
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def lines_of(source: str) -> list[str]:
    parts = source.split("\n")
    if parts and not parts[-1]:
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def text_of(e: ast.AST | None) -> str | None:
    return e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None


Problem = tuple[str, str, int, int]
#: Attempts to mend a broken statement line by line before it is cut into its blocks, and how often over a source may be read again
#: to find where open statements end; then an open statement counts as broken. Marks of a statement that goes on beyond its lines.
TRIES, REREADS = 12, 32
_OPEN_ENDED = ("was never closed", "unterminated triple-quoted", "unexpected EOF")
_GOES_ON = re.compile(r"[\s#)\]}]|(?:elif|else|except|finally)\b|$")


def _parsed(text: str) -> tuple[ast.Module | None, Exception | None]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, e


def _problem(e: Exception, offset: int = 0) -> Problem:
    if isinstance(e, (RecursionError, MemoryError)):
        return "warning", "nested deeper than the parser goes", 1 + offset, 1
    text = getattr(e, "msg", None) or str(e) or "invalid syntax"
    deep = "too many nested" in text or "too many statically nested" in text or ("indentation" in text and "too many" in text)
    return "warning" if deep else "error", text, (getattr(e, "lineno", None) or 1) + offset, getattr(e, "offset", None) or 1


def _margin(row: str) -> str:
    return row[: len(row) - len(row.lstrip())]


def _mend(rows: list[str]) -> ast.Module | None:
    """The tree of a broken statement's ``rows``, which are changed: a line that can't be read becomes ``pass``, or ``if 1:`` where a block hangs on it.

    A few lines are mended one after the other; a statement with more of them is cut into its blocks, and each of their
    statements is mended alone, so the work grows with the number of lines and none is too many.
    """
    some = list(rows)
    tree = _mend_lines(some)
    if tree is None:
        some = list(rows)
        tree = _mend_blocks(some)
    rows[:] = some
    return tree


def _mend_blocks(rows: list[str]) -> ast.Module | None:
    """As ``_mend``, by the blocks that hang on the lines of the least margin."""
    base = len(_margin(next((r for r in rows if r.strip()), "")))
    heads = [k for k, r in enumerate(rows) if r.strip() and len(_margin(r)) <= base]
    hung: list[int] = []  # heads with a block
    for at, end in zip(heads, [*heads[1:], len(rows)], strict=True):
        block = [k for k in range(at + 1, end) if rows[k].strip()]
        if not block:
            if _parsed(rows[at].strip())[0] is None:
                rows[at] = _margin(rows[at]) + "pass"
            continue
        hung.append(at)
        edge = min((_margin(rows[k]) for k in block), key=len)
        inner = [rows[k][len(edge) :] for k in range(at + 1, end)]
        _read(inner)
        for k, text in enumerate(inner, at + 1):
            rows[k] = edge + text if text.strip() else ""
        if _parsed(f"{rows[at].strip()}\n pass")[0] is None and _parsed(f"if 1: pass\n{rows[at].strip()}\n pass")[0] is None and _parsed(f"try: pass\n{rows[at].strip()}\n pass")[0] is None:
            rows[at] = _margin(rows[at]) + "if 1:"
    tree = _parsed("\n".join(rows))[0]
    if tree is None:  # the heads don't belong together
        for at in heads:
            rows[at] = _margin(rows[heads[0]]) + ("if 1:" if at in hung else "pass")
        tree = _parsed("\n".join(rows))[0]
    return tree


def _mend_lines(rows: list[str]) -> ast.Module | None:
    mended: set[int] = set()
    for _ in range(min(TRIES, 2 * len(rows) + 1)):
        tree, e = _parsed("\n".join(rows))
        if tree is not None:
            return tree
        if not isinstance(e, SyntaxError):
            return None
        at = min(max((e.lineno or 1) - 1, 0), len(rows) - 1)
        before = next((k for k in range(at - 1, -1, -1) if rows[k].strip()), None)
        margin = lambda k: _margin(rows[k])
        text = e.msg or ""
        if "unexpected indent" in text and before in mended:
            rows[before] = margin(before) + "if 1:"
        elif ("unexpected indent" in text or "unindent does not match" in text) and at not in mended:
            rows[at] = (margin(before) if before is not None else "") + rows[at].strip()
            mended.add(at)
        else:
            if before is not None and before not in mended and ("expected an indented block" in text or rows[before].lstrip().startswith("@")):
                at = before
            elif at in mended:
                at = next((k for k in [*range(at, -1, -1), *range(at, len(rows))] if k not in mended and rows[k].strip()), None)
                if at is None:
                    return None
            body = next((k for k in range(at + 1, len(rows)) if rows[k].strip()), None)
            deeper = body is not None and len(margin(body)) > len(margin(at)) and "expected an indented block" not in text
            rows[at] = margin(at) + ("if 1:" if deeper else "pass")
            mended.add(at)
    return None


def parse(source: str) -> tuple[ast.Module | None, list[Problem], list[str]]:
    """The tree of the source, what was wrong, and the rows that the tree's places refer to. A source that doesn't parse is read by its top-level statements: those that parse are whole, and of one that doesn't the lines that can't be read are left out."""
    tree, e = _parsed(source)
    if tree is not None:
        return tree, [], source.split("\n")
    rows = source.replace("\0", " ").split("\n")
    first = _problem(e)
    body, told = _read(rows)
    return (ast.Module(body, []) if body is not None else None), [first, *(p for p in told if p[2:] != first[2:])], rows


def _read(rows: list[str]) -> tuple[list[ast.stmt] | None, list[Problem]]:
    """The statements of rows that don't parse as a whole, and what was wrong with those that don't; ``rows`` become what was read."""
    starts = [i for i, r in enumerate(rows) if not _GOES_ON.match(r) and not (i and rows[i - 1].startswith("@"))] or [0]
    starts[0] = 0
    ends = [*starts[1:], len(rows)]
    body: list[ast.stmt] = []
    problems: list[Problem] = []
    i, found, room = 0, False, REREADS * (sum(map(len, rows)) + len(rows) + 1)
    while i < len(starts):
        j, lo = i, starts[i]
        tree, e = _parsed("\n".join(rows[lo : ends[i]]))
        step = 1
        while tree is None and isinstance(e, SyntaxError) and any(x in (e.msg or "") for x in _OPEN_ENDED) and i + step // 2 < len(starts) - 1 and room > 0:
            j = min(i + step, len(starts) - 1)
            text = "\n".join(rows[lo : ends[j]])
            room -= len(text)
            tree, e = _parsed(text)
            step *= 2
        if tree is None:
            if not isinstance(e, (RecursionError, MemoryError)):
                _, e = _parsed("\n".join(rows[lo : ends[i]]))
            j = i
            if e:
                problems.append(_problem(e, lo))
            some = rows[lo : ends[i]]
            tree = _mend(some)
            rows[lo : ends[i]] = some
        if tree is not None:
            found = True
            body += ast.increment_lineno(tree, lo).body
        i = j + 1
    return (body if found else None), problems


class Walk:
    def __init__(self, source: str):
        self.source, self.rows = source, source.split("\n")
        self.bytes = [None] * len(self.rows)
        self.aliases: dict[str, str] = {}
        self.roots: set[str] = set()
        self.stars: list[str] = []
        self.scopes: list[tuple[str, set[str]]] = [("module", set())]
        self.path: list[str] = ["<module>"]
        self.kinds: dict[str, str] = {}
        self.consts: dict[str, str] = {}
        self.origins: dict[str, str] = {}
        self.called: dict[str, str] = {}
        self.calls, self.env, self.imports, self.nodes = [], [], [], []
        self.bindings: dict[str, dict] = {}
        self.reads: dict[str, int] = {}
        self.count = dict.fromkeys("statements complexity functions classes async_defs calls imports loops branches handlers".split(), 0)
        self.problems: list[tuple[str, str, int, int]] = []
        self.seq = self.deep = self.loops = 0
        self.owner = 0

    # ---- places in the source

    def column(self, line: int, offset: int) -> int:
        if self.rows[line - 1].isascii():
            return offset + 1
        return len(self.rows[line - 1].encode()[:offset].decode(errors="ignore")) + 1

    def segment(self, e: ast.AST) -> str:
        l0, l1 = e.lineno - 1, e.end_lineno - 1
        c0, c1 = self.column(l0 + 1, e.col_offset) - 1, self.column(l1 + 1, e.end_col_offset) - 1
        return self.rows[l0][c0:c1] if l0 == l1 else "\n".join([self.rows[l0][c0:], *self.rows[l0 + 1 : l1], self.rows[l1][:c1]])

    def brief(self, e: ast.AST, budget: int) -> str:
        return brief(e, budget, self.segment)

    # ---- what names mean

    def bound(self, name: str) -> bool:
        """Whether this scope, an enclosing function or the module binds the name; outer class bodies don't count."""
        inner = len(self.scopes) - 1
        return any(name in names for i, (kind, names) in enumerate(self.scopes) if kind != "class" or i == inner)

    def resolve(self, e: ast.AST, fuel: int = FUEL) -> str | None:
        if not fuel:
            return None
        fuel -= 1
        match e:
            case ast.Name(id=name):
                if name in self.called:
                    return self.called[name]
                if self.kinds.get(name) in PREFIX:
                    return PREFIX[self.kinds[name]]
                if name in self.aliases:
                    return self.aliases[name]
                if self.stars and not self.bound(name):
                    for path in (f"{m}.{name}" for m in self.stars):
                        if path in KNOWN or path in PRODUCES:
                            return path
                return name
            case ast.Attribute(value=value, attr=attr):
                base = self.resolve(value, fuel)
                return None if base is None else f"{base}.{attr}"
            case ast.Call(func=func, args=args):
                base = self.resolve(func, fuel)
                if base in ("__import__", "importlib.import_module") and args and text_of(args[0]) is not None:
                    return text_of(args[0])
                return None if base is None else PREFIX.get(PRODUCES.get(base, ""), base)
            case ast.Subscript(value=value) | ast.Await(value=value):
                return self.resolve(value, fuel)
            case ast.BinOp(left=left, right=right):
                return "<path>" if "<path>" in (self.resolve(left, fuel), self.resolve(right, fuel)) else None
        return None

    def kind(self, e: ast.AST) -> str:
        match e:
            case ast.Constant(value=bool()):
                return "bool"
            case ast.Constant(value=None):
                return "none"
            case ast.Constant(value=str()) | ast.JoinedStr():
                return "text"
            case ast.Constant(value=int() | float() | complex()):
                return "number"
            case ast.List() | ast.Tuple() | ast.ListComp() | ast.Set():
                return "seq"
            case ast.Dict() | ast.DictComp():
                return "map"
            case ast.Lambda():
                return "callable"
        path = self.resolve(e) or ""
        return PRODUCES.get(path) or KIND_OF.get(path, "unknown")

    def callable_path(self, e: ast.AST) -> str | None:
        """The known callable that an assigned value names."""
        match e:
            case ast.Name() | ast.Attribute():
                path = self.resolve(e)
            case ast.Call(func=func, args=[target, name, *_]) if text_of(name) is not None and self.resolve(func) == "getattr":
                base = self.resolve(target)
                path = base and f"{base}.{text_of(name)}"
            case _:
                return None
        return path if path and (path in KNOWN or path in PRODUCES or path == "open" or path[0] == "<") else None

    def hide(self):
        """What a def or class body learns of values doesn't leak out of it."""
        return [dict(x) for x in (self.kinds, self.consts, self.origins, self.called)]

    def unhide(self, saved) -> None:
        self.kinds, self.consts, self.origins, self.called = saved

    # ---- first pass

    def prescan(self, body: list[ast.stmt], deferred: bool = False, top: bool = True) -> None:
        names = self.scopes[0][1]
        for s in body:
            match s:
                case ast.Import(names=found):
                    for a in found:
                        root = a.name.split(".")[0]
                        target = a.name if a.asname else root
                        self.roots.add(target.split(".")[0])
                        self.aliases[a.asname or root] = target
                        self.imports.append((a.name, [], a.asname, s.lineno, 0, deferred))
                case ast.ImportFrom(module=module, names=found, level=level):
                    path = "." * level + module if module else "." * max(1, level)
                    self.roots.add(path.split(".")[0])
                    for a in found:
                        if a.name == "*":
                            self.stars.append(path)
                        else:
                            self.aliases[a.asname or a.name] = f"{path}.{a.name}"
                    self.imports.append((path, [f"{a.name} as {a.asname}" if a.asname else a.name for a in found], None, s.lineno, level, deferred))
                case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                    if top:
                        names.add(s.name)
                    self.prescan(s.body, True, False)
                case ast.If():
                    self.prescan(s.body, deferred, top)
                    self.prescan(s.orelse, deferred, top)
                case ast.Try() | ast.TryStar():
                    for part in (s.body, *(h.body for h in s.handlers), s.orelse, s.finalbody):
                        self.prescan(part, True, top)
                case ast.For() | ast.AsyncFor() | ast.While() | ast.With() | ast.AsyncWith():
                    self.prescan(s.body, deferred, top)
                case ast.Assign(targets=targets) if top:
                    names.update(t.id for t in targets if isinstance(t, ast.Name))

    def local_names(self, body: list[ast.stmt]) -> None:
        names = self.scopes[-1][1]
        for s in body:
            if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
                names.add(s.name)
            elif isinstance(s, ast.Assign):
                names.update(t.id for t in s.targets if isinstance(t, ast.Name))

    # ---- calls and other facts

    def next(self) -> int:
        self.seq += 1
        return self.seq

    def target(self, e: ast.AST) -> str:
        """What an argument denotes: a literal's or a constant name's value, a list of literals joined, else its source."""
        literal = text_of(e)
        if literal is None and isinstance(e, ast.Name):
            literal = self.consts.get(e.id)
        if literal is None and isinstance(e, (ast.List, ast.Tuple)) and e.elts and all(text_of(x) is not None for x in e.elts):
            literal = " ".join(text_of(x) for x in e.elts)
        return clip(squeeze(literal), TARGET) if literal is not None else self.brief(e, TARGET)

    def strings(self, e: ast.AST) -> list[str]:
        match e:
            case ast.Constant(value=str(v)):
                return [v]
            case ast.JoinedStr(values=parts):
                return [p.value for p in parts if isinstance(p, ast.Constant)]
            case ast.Name(id=name) if name in self.consts:
                return [self.consts[name]]
            case ast.List(elts=elts) | ast.Tuple(elts=elts):
                return [" ".join(t for t in map(text_of, elts) if t is not None)]
        return []

    def keyword(self, k: ast.keyword) -> tuple[str, str, str | None]:
        """(name, true | false | path | other, path)."""
        match k.value:
            case ast.Constant(value=bool(v)):
                return k.arg, "true" if v else "false", None
            case ast.Constant(value=None):
                return k.arg, "false", None
            case ast.Constant(value=int(v)):
                return k.arg, "true" if v else "false", None
            case ast.Name() | ast.Attribute():
                path = self.resolve(k.value)
                return k.arg, "path" if path else "other", path
        return k.arg, "other", None

    def on_call(self, c: ast.Call) -> None:
        self.count["calls"] += 1
        f = c.func
        if isinstance(f, ast.Name) and self.bound(f.id) and f.id not in self.aliases and f.id not in self.called:
            return
        path = self.resolve(f)
        if path is None:
            return
        receiver = None
        if isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Name):
                known = self.consts.get(f.value.id)
                receiver = clip(squeeze(known), TARGET) if known is not None else self.origins.get(f.value.id)
            else:
                receiver = self.brief(f.value, TARGET)
        named = {k.arg: k.value for k in c.keywords if k.arg}
        positional = []
        for a in c.args:
            if isinstance(a, ast.Starred):
                break
            positional.append(a)
        mode = named.get("mode") or (positional[1] if len(positional) > 1 else None)
        texts = [t for a in (*c.args, *(k.value for k in c.keywords)) for t in self.strings(a)]
        self.calls.append((
            self.next(), self.owner, c.lineno, self.column(c.lineno, c.col_offset), path, clip(squeeze(self.segment(f)), DISPLAY), clip(squeeze(self.segment(c)), SNIPPET),
            receiver, text_of(mode) if mode is not None else None, [self.target(a) for a in positional], {k: self.target(v) for k, v in named.items()}, texts,
            [self.keyword(k) for k in c.keywords if k.arg], self.bound(path),
        ))

    def on_environ(self, s: ast.Subscript, verb: str) -> bool:
        if self.resolve(s.value) != "os.environ":
            return False
        self.env.append((self.next(), self.owner, s.lineno, self.column(s.lineno, s.col_offset), verb, text_of(s.slice), clip(squeeze(self.segment(s)), SNIPPET)))
        return True

    # ---- expressions

    def each(self, items) -> None:
        for e in items:
            if e is not None:
                self.expr(e)

    def expr(self, e: ast.AST) -> None:
        if self.deep >= EXPRESSIONS_DEEP:
            self.limit("an expression", EXPRESSIONS_DEEP, e)
            return
        self.deep += 1
        match e:
            case ast.Call():
                self.on_call(e)
                self.each([e.func, *e.args, *(k.value for k in e.keywords)])
            case ast.Subscript():
                self.on_environ(e, "getenv")
                self.each([e.value, e.slice])
            case ast.Attribute():
                if e.attr == "argv" and self.resolve(e.value) == "sys":
                    self.env.append((self.next(), self.owner, e.lineno, self.column(e.lineno, e.col_offset), "argv", None, clip(squeeze(self.segment(e)), SNIPPET)))
                self.expr(e.value)
            case ast.Name():
                if isinstance(e.ctx, ast.Load):
                    self.reads[e.id] = self.reads.get(e.id, 0) + 1
            case ast.BoolOp():
                self.count["complexity"] += len(e.values) - 1
                self.each(e.values)
            case ast.NamedExpr():
                self.bind(e.target.id, "walrus", self.kind(e.value), e.value, e.lineno)
                self.expr(e.value)
            case ast.Lambda():
                self.each([*e.args.defaults, *e.args.kw_defaults])
                self.scopes.append(("function", {p.lstrip("*") for p in parameters(e.args)}))
                self.expr(e.body)
                self.scopes.pop()
            case ast.IfExp():
                self.count["complexity"] += 1
                self.each([e.test, e.body, e.orelse])
            case ast.Dict():
                self.each([x for pair in zip(e.keys, e.values, strict=True) for x in pair])
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                self.scopes.append(("function", set()))
                for g in e.generators:
                    self.count["complexity"] += 1 + len(g.ifs)
                    self.expr(g.iter)
                    self.bind_target(g.target, "comprehension", "unknown", g.iter, g.target.lineno)
                    self.each(g.ifs)
                self.each([e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt])
                self.scopes.pop()
            case ast.JoinedStr():
                self.each(v.value for v in e.values if isinstance(v, ast.FormattedValue))
            case ast.Constant():
                pass
            case _:
                self.each(x for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr))
        self.deep -= 1

    def limit(self, what: str, depth: int, e: ast.AST) -> None:
        if not any(p[0] == "warning" for p in self.problems):
            self.problems.append(("warning", f"{what} nested deeper than {depth} levels was not analysed", e.lineno, self.column(e.lineno, e.col_offset)))

    # ---- bindings

    def bind(self, name: str, kind: str, value: str, origin: ast.AST | str, line: int) -> None:
        if name == "_":
            return
        plain = isinstance(origin, str)
        label = clip(origin, ORIGIN) if plain else self.brief(origin, ORIGIN)
        text = label if plain else clip(squeeze(self.segment(origin)), ORIGIN)
        if not plain:
            literal, path = text_of(origin), self.callable_path(origin)
            for table, found in ((self.consts, literal), (self.called, path)):
                if found is not None and kind == "assign":
                    table[name] = found
                else:
                    table.pop(name, None)
            self.origins[name] = label
        if value != "unknown":
            self.kinds[name] = value
        self.scopes[-1][1].add(name)
        piles = kind == "augment" and self.loops > 0
        b = self.bindings.get(name)
        if b is None:
            self.bindings[name] = {"name": name, "kind": kind, "value": value, "origin": label, "text": text, "scope": ".".join(self.path[1:]) or "<module>", "line": line, "depth": len(self.path) - 1, "rebinds": 0, "accumulates": piles}
        elif not plain:
            b["rebinds"] += 1
            b["accumulates"] |= piles
            if b["value"] == "unknown":
                b["value"] = value

    def bind_target(self, t: ast.AST, kind: str, value: str, origin: ast.AST, line: int) -> None:
        match t:
            case ast.Name(id=name):
                self.bind(name, kind, value, origin, line)
            case ast.Tuple(elts=elts) | ast.List(elts=elts):
                for x in elts:
                    self.bind_target(x, kind, "unknown", origin, line)
            case ast.Starred(value=inner):
                self.bind_target(inner, kind, "seq", origin, line)

    def store(self, t: ast.AST) -> None:
        match t:
            case ast.Subscript():
                self.on_environ(t, "setenv")
                self.each([t.value, t.slice])
            case ast.Attribute(value=value):
                self.expr(value)
            case ast.Tuple(elts=elts) | ast.List(elts=elts):
                for x in elts:
                    self.store(x)
            case ast.Starred(value=inner):
                self.store(inner)

    # ---- statements

    def node(self, parent: list[int], kind: str, label: str, detail: str | None, line: int, end: int) -> list[int]:
        """Add a statement of the outline; the path of ids down to it."""
        me = len(self.nodes)
        self.nodes.append((me, parent[-1] if parent else -1, [*parent, me], kind, clip(label, LABEL), detail, line, end, max(0, len(parent) - 1)))
        return [*parent, me]

    def block(self, body: list[ast.stmt], parent: list[int]) -> None:
        for s in body:
            self.stmt(s, parent)

    def arm(self, keyword: str, body: list[ast.stmt], parent: list[int]) -> None:
        if body:
            self.block(body, self.node(parent, "branch_arm", keyword, None, body[0].lineno, body[-1].end_lineno))

    def inner(self, s, kind: str, body: list[ast.stmt], here: list[int]) -> None:
        """A def's or class's body in a scope of its own."""
        self.path.append(s.name)
        saved, loops = self.hide(), self.loops
        self.scopes.append((kind, set()))
        if kind == "function":
            self.loops = 0
            for p in parameters(s.args):
                self.bind(p.lstrip("*"), "param", "unknown", p.lstrip("*"), s.lineno)
        self.local_names(body)
        self.block(body, here)
        self.scopes.pop()
        self.unhide(saved)
        self.loops = loops
        self.path.pop()

    def stmt(self, s: ast.stmt, parent: list[int]) -> None:
        self.count["statements"] += 1
        line, end = s.lineno, s.end_lineno
        if getattr(s, "decorator_list", None):
            line = s.decorator_list[-1].end_lineno
        if len(parent) - 1 > STATEMENTS_DEEP:
            self.limit("a block", STATEMENTS_DEEP, s)
            self.node(parent, "expr", squeeze(self.segment(s)), "not analysed: too deeply nested", line, end)
            return
        add = lambda kind, label, detail=None: self.node(parent, kind, label, detail, line, end)
        outer, self.owner = self.owner, len(self.nodes)
        b = self.brief
        match s:
            case ast.Import() | ast.ImportFrom():
                self.count["imports"] += len(s.names)
                written = [f"{a.name} as {a.asname}" if a.asname else a.name for a in s.names]
                head = ""
                if isinstance(s, ast.ImportFrom):
                    head = f"from {'.' * s.level + s.module if s.module else '.' * max(1, s.level)} "
                if len(self.path) > 1:
                    for a in s.names:
                        if a.name != "*":
                            self.bind(a.asname or (a.name if head else a.name.split(".")[0]), "import", "unknown" if head else "module", f"{head}import {a.name}", line)
                add("import", f"{head}import {', '.join(written)}")
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self.count["functions"] += 1
                word = "def"
                if isinstance(s, ast.AsyncFunctionDef):
                    self.count["async_defs"] += 1
                    word = "async def"
                self.each([*s.decorator_list, *s.args.defaults, *s.args.kw_defaults])
                label = clip(f"{word} {s.name}({', '.join(parameters(s.args))})", LABEL)
                detail = ([f"→ {b(s.returns, 24)}"] if s.returns else []) + [f"@{b(d, 20)}" for d in s.decorator_list]
                self.inner(s, "function", s.body, add("def", label, "  ".join(detail) or None))
                self.bind(s.name, "def", "callable", label, line)
            case ast.ClassDef():
                self.count["classes"] += 1
                self.each(s.decorator_list)
                bases = ", ".join(b(x, 20) for x in s.bases)
                label = clip(f"class {s.name}({bases})" if bases else f"class {s.name}", LABEL)
                self.inner(s, "class", s.body, add("class", label))
                self.bind(s.name, "class", "class", label, line)
            case ast.For() | ast.AsyncFor() | ast.While():
                self.count["loops"] += 1
                self.count["complexity"] += 1
                if isinstance(s, ast.While):
                    self.expr(s.test)
                    here = add("loop", f"while {b(s.test, LABEL - 6)}")
                else:
                    self.expr(s.iter)
                    self.bind_target(s.target, "loop_var", "unknown", s.iter, line)
                    here = add("loop", f"{'async ' * isinstance(s, ast.AsyncFor)}for {b(s.target, 24)} in {b(s.iter, LABEL // 2)}")
                self.loops += 1
                self.block(s.body, here)
                self.loops -= 1
                self.arm("else", s.orelse, here)
            case ast.If():
                self.count["branches"] += 1
                self.count["complexity"] += 1
                self.expr(s.test)
                here = add("branch", f"if {b(s.test, LABEL - 3)}")
                self.block(s.body, here)
                rest = s.orelse
                while len(rest) == 1 and isinstance(rest[0], ast.If) and self.rows[rest[0].lineno - 1][rest[0].col_offset :].startswith("elif"):
                    test, body = rest[0].test, rest[0].body
                    self.count["branches"] += 1
                    self.count["complexity"] += 1
                    self.owner = len(self.nodes)
                    self.expr(test)
                    self.block(body, self.node(here, "branch_arm", f"elif {b(test, LABEL - 5)}", None, rest[0].lineno, body[-1].end_lineno))
                    rest = rest[0].orelse
                self.arm("else", rest, here)
            case ast.Match():
                self.count["branches"] += 1
                self.expr(s.subject)
                here = add("branch", f"match {b(s.subject, LABEL - 6)}")
                for case in s.cases:
                    self.count["complexity"] += 1
                    pattern = clip(squeeze(self.segment(case.pattern)), LABEL - 6)
                    self.block(case.body, self.node(here, "branch_arm", f"case {pattern}", None, case.pattern.lineno, case.body[-1].end_lineno))
            case ast.With() | ast.AsyncWith():
                items = []
                for item in s.items:
                    self.expr(item.context_expr)
                    if item.optional_vars is not None:
                        self.bind_target(item.optional_vars, "with_var", self.kind(item.context_expr), item.context_expr, line)
                    items.append(b(item.context_expr, 40) + (f" as {b(item.optional_vars, 12)}" if item.optional_vars is not None else ""))
                self.block(s.body, add("with", f"{'async ' * isinstance(s, ast.AsyncWith)}with {', '.join(items)}"))
            case ast.Try() | ast.TryStar():
                here = add("try", "try")
                self.block(s.body, here)
                for h in s.handlers:
                    self.count["handlers"] += 1
                    self.count["complexity"] += 1
                    self.owner = len(self.nodes)
                    label = "except"
                    if h.type is not None:
                        self.expr(h.type)
                        label += f" {b(h.type, 30)}"
                    if h.name:
                        label += f" as {h.name}"
                        self.bind(h.name, "except_var", "unknown", label, h.lineno)
                    self.block(h.body, self.node(here, "handler", label, None, h.lineno, h.end_lineno))
                self.arm("else", s.orelse, here)
                self.arm("finally", s.finalbody, here)
            case ast.Assign():
                self.expr(s.value)
                kind = self.kind(s.value)
                for t in s.targets:
                    self.store(t)
                    self.bind_target(t, "assign", kind, s.value, line)
                left = " = ".join(b(t, 24) for t in s.targets)
                add("assign", f"{left} = {b(s.value, max(0, LABEL - len(left) - 3))}")
            case ast.AugAssign():
                self.expr(s.value)
                self.store(s.target)
                self.bind_target(s.target, "augment", "unknown", s.value, line)
                left = b(s.target, 24)
                add("assign", f"{left} {operator(s.op)}= {b(s.value, max(0, LABEL - len(left) - 4))}")
            case ast.AnnAssign():
                if s.value is not None:
                    self.expr(s.value)
                    self.bind_target(s.target, "annotate", self.kind(s.value), s.value, line)
                add("assign", squeeze(self.segment(s)))
            case ast.Return() | ast.Raise() | ast.Assert():
                word = type(s).__name__.lower()
                first = s.value if word == "return" else s.exc if word == "raise" else s.test
                self.each([first, s.cause if word == "raise" else s.msg if word == "assert" else None])
                self.count["complexity"] += word == "assert"
                add(word, f"{word} {b(first, LABEL - len(word) - 1)}" if first is not None else word)
            case ast.Delete():
                for t in s.targets:
                    if isinstance(t, ast.Subscript):
                        self.on_environ(t, "unsetenv")
                        self.each([t.value, t.slice])
                    else:
                        self.expr(t)
                add("delete", f"del {', '.join(b(t, 24) for t in s.targets)}")
            case ast.Global() | ast.Nonlocal():
                add("global", f"{type(s).__name__.lower()} {', '.join(s.names)}")
            case ast.Expr():
                self.expr(s.value)
                if text_of(s.value) is not None:
                    add("expr", '"""docstring"""', clip(squeeze(text_of(s.value)), LABEL))
                else:
                    add("call" if isinstance(s.value, (ast.Call, ast.Await)) else "expr", b(s.value, LABEL))
            case ast.Pass():
                add("pass", "pass")
            case ast.Break() | ast.Continue():
                add("jump", type(s).__name__.lower())
            case _:
                add("assign", squeeze(self.segment(s)))
        self.owner = outer


_COMMENT = re.compile(r"\s*#")


def _last(nodes: list[tuple]) -> list[int]:
    """The last descendant of each node: ids go down the tree before they go on."""
    last = list(range(len(nodes)))
    for n in reversed(nodes):
        if n[1] >= 0:
            last[n[1]] = max(last[n[1]], last[n[0]])
    return last


def _told(source: str, w: Walk, rows: list[str], failed: bool, parsed: bool) -> dict:
    blank = sum(not r.strip() for r in rows)
    comment = sum(bool(_COMMENT.match(r)) for r in rows)
    depth = max((len(n[2]) - 2 for n in w.nodes), default=0) if len(w.nodes) > 1 else 0
    counters = w.count | {"complexity": w.count["complexity"] + (not failed), "lines_total": len(rows), "lines_blank": blank, "lines_comment": comment, "lines_code": len(rows) - blank - comment, "max_depth": depth, "outlined": len(w.nodes) - 1}
    kinds: list[str | None] = [None] * len(rows)
    for n in w.nodes[1:]:
        if n[6] <= len(rows) and kinds[n[6] - 1] is None:
            kinds[n[6] - 1] = n[3]
    return {
        "parsed": parsed, "failed": failed, "bytes": len(source.encode(errors="replace")), "calls": w.calls, "env": w.env, "imports": w.imports, "roots": sorted(w.roots), "bindings": [tuple(v.values()) for v in w.bindings.values()],
        "reads": list(w.reads.items()), "nodes": [(*n, last) for n, last in zip(w.nodes, _last(w.nodes), strict=True)], "problems": w.problems, "counters": counters, "line_kinds": kinds,
    }


def facts(source: str | None) -> dict:
    """The facts of one snippet; never raises. What the walk can't finish gives an empty, honest answer: not parsed, failed, and why."""
    source = source or ""
    rows = lines_of(source)
    try:
        w = Walk(source)
        tree, problems, w.rows = parse(source)
        w.problems += problems
        w.node([], "module", "module", None, 1, max(1, len(rows)))
        parsed = tree is not None
        if tree is not None:
            try:
                w.prescan(tree.body)
                w.block(tree.body, [0])
            except RecursionError:
                w.problems.append(("warning", "nested deeper than the walk goes", 1, 1))
                parsed = False
        return _told(source, w, rows, False, parsed and not any(p[0] == "error" for p in w.problems))
    except Exception as e:  # one odd source must not fail its task
        w = Walk("")
        w.node([], "module", "module", None, 1, max(1, len(rows)))
        w.problems.append(("error", f"this snippet could not be analysed: {type(e).__name__}: {e}", 1, 1))
        return _told(source, w, rows, True, False)
