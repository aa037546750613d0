"""Short labels for source text and expressions."""

from __future__ import annotations

import ast
from collections.abc import Callable

DEEP = 32
#: A text that is cut is cut before one of these, if one is in its last third.
BREAKS = " ,(["


def squeeze(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return " ".join(text.split())


def clip(text: str, size: int) -> str:
    """At most ``size`` characters; a cut text ends in an ellipsis, at a break where there is one in its last third."""
    if len(text) <= size:
        return text
    head = text[: max(0, size - 1)]
    at = max(head.rfind(c) for c in BREAKS)
    return (head[:at] if at > 2 * len(head) // 3 else head) + "…" if size else ""


def parameters(a: ast.arguments) -> list[str]:
    names = [p.arg for p in (*a.posonlyargs, *a.args)]
    if a.vararg:
        names.append(f"*{a.vararg.arg}")
    names += [p.arg for p in a.kwonlyargs]
    return names + ([f"**{a.kwarg.arg}"] if a.kwarg else [])


def dotted(e: ast.AST) -> str | None:
    parts: list[str] = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    return ".".join([e.id, *parts[::-1]]) if isinstance(e, ast.Name) else None


def brief(e: ast.AST, budget: int, source: Callable[[ast.AST], str], depth: int = 0) -> str:
    """The expression's own source where that is short, else its shape."""
    raw = squeeze(source(e))
    if len(raw) <= budget or depth > DEEP:
        return clip(raw, budget)
    return clip(_shape(e, budget, source, depth + 1), budget)


def _many(n: int, one: str, ends: str) -> str:
    return f"{ends[0]}{n} {one}{'' if n == 1 else 's'}{ends[1]}"


def _shape(e: ast.AST, budget: int, source, depth: int) -> str:
    short = lambda x, n: brief(x, n, source, depth + 1)
    match e:
        case ast.Dict():
            return _many(len(e.keys), "key", "{}")
        case ast.Set():
            return _many(len(e.elts), "item", "{}")
        case ast.List():
            return _many(len(e.elts), "item", "[]")
        case ast.Tuple():
            return _many(len(e.elts), "item", "()")
        case ast.ListComp():
            return "[… for …]"
        case ast.SetComp():
            return "{… for …}"
        case ast.DictComp():
            return "{…: … for …}"
        case ast.GeneratorExp():
            return "(… for …)"
        case ast.Lambda():
            return f"lambda {', '.join(parameters(e.args))}".strip()
        case ast.JoinedStr():
            return 'f"…"'
        case ast.Constant(value=str(v)):
            return '"' + clip(squeeze(v), budget - 2).replace("\\", "\\\\").replace('"', '\\"') + '"'
        case ast.Constant(value=bytes()):
            return 'b"…"'
        case ast.Call():
            name = dotted(e.func) or clip(_chain(e.func, source, depth), 28)
            n = len(e.args) + len(e.keywords)
            if not e.args:
                return f"{name}(…{n})" if n else f"{name}()"
            head = short(e.args[0], max(8, budget - len(name) - 6))
            return f"{name}({head}, …{n - 1})" if n > 1 else f"{name}({head})"
        case ast.BoolOp():
            return f"… {'and' if isinstance(e.op, ast.And) else 'or'} … ({len(e.values)} terms)"
        case ast.BinOp():
            return f"{short(e.left, budget // 3)} {operator(e.op)} {short(e.right, budget // 3)}"
        case ast.Compare():
            return f"{short(e.left, budget // 3)} {operator(e.ops[0])} {short(e.comparators[0], budget // 3)}"
        case ast.Subscript():
            return f"{short(e.value, budget - 3)}[…]"
        case ast.IfExp():
            return "… if … else …"
        case ast.Await():
            return f"await {short(e.value, budget - 6)}"
    return dotted(e) or clip(squeeze(source(e)), budget)


def operator(op: ast.AST) -> str:
    pair = ast.Compare(ast.Name("a"), [op], [ast.Name("b")]) if isinstance(op, ast.cmpop) else ast.BinOp(ast.Name("a"), op, ast.Name("b"))
    return ast.unparse(pair)[2:-2]


def _chain(e: ast.AST, source, depth: int) -> str:
    match e:
        case _ if depth > DEEP:
            return squeeze(source(e))
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=value, attr=attr):
            return f"{_chain(value, source, depth + 1)}.{attr}"
        case ast.Call(func=func, args=args, keywords=keywords):
            return _chain(func, source, depth + 1) + ("(…)" if args or keywords else "()")
        case ast.Subscript(value=value):
            return f"{_chain(value, source, depth + 1)}[…]"
    return squeeze(source(e))
