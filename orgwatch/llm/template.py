"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                 the value of an expression, as text
    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}    marks text that the model is to be trained on
    {# comment #}

Expressions: string and integer literals, names, ``a.b``, ``a["b"]``, ``a + b``, ``==``, ``!=``, ``and``, ``or``,
``not``, ``(...)`` and filters ``a | name``. Names come from the given context only, members from mappings only, and
filters from the given table only, so a template can reach nothing else. Expressions of literals are folded when the
template is compiled, and neighbouring constant texts are merged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

Expression = Callable[[dict], Any]

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<int>\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|[.\[\]()+|]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class Output:
    """Collects text and the spans of it that lie between generation markers."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self.open: list[int] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


# The syntax tree: tuples whose first item is the kind. ------------------------------------------------------------


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "int":
            value = int(value)
        elif kind == "str":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.S)
        out.append((kind, value))
        at = m.end()
    return out


class _Reader:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.items, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.items[self.at] if self.at < len(self.items) else ("end", None)

    def take(self, *wanted: tuple[str, Any]) -> tuple[str, Any] | None:
        if self.peek() in wanted:
            self.at += 1
            return self.items[self.at - 1]
        return None

    def need(self, kind: str) -> Any:
        if self.peek()[0] != kind:
            raise TemplateError(f"expected {kind}, found {self.peek()[1]!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take(("name", "or")):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take(("name", "and")):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self) -> tuple:
        left = self.added()
        while op := self.take(("op", "=="), ("op", "!=")):
            left = (op[1], left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while self.take(("op", "+")):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.member()
        while self.take(("op", "|")):
            left = ("filter", left, self.need("name"))
        return left

    def member(self) -> tuple:
        left = self.primary()
        while op := self.take(("op", "."), ("op", "[")):
            if op[1] == ".":
                left = ("member", left, ("const", self.need("name")))
            else:
                left = ("member", left, self.either())
                if not self.take(("op", "]")):
                    raise TemplateError("expected ]")
        return left

    def primary(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind in ("int", "str"):
            return ("const", value)
        if kind == "name":
            return ("const", value == "true") if value in ("true", "false") else ("name", value)
        if (kind, value) == ("op", "("):
            tree = self.either()
            if not self.take(("op", ")")):
                raise TemplateError("expected )")
            return tree
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The statements of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("put", m[1]))
        elif m[2] is not None:
            pieces.append(("do", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while pieces:
            kind, body = pieces.pop()
            if kind == "text":
                out.append(("text", body))
            elif kind == "put":
                out.append(("put", _Reader(body).whole()))
            elif body.split(" ")[0] in ends:
                return out, body
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.*)", body, re.S):
                inner, _ = block("endfor")
                out.append(("for", m[1], _Reader(m[2]).whole(), inner))
            elif body.startswith("if "):
                arms, rest, test = [], [], body[3:]
                while True:
                    inner, end = block("elif", "else", "endif")
                    arms.append((_Reader(test).whole(), inner))
                    if end.startswith("elif "):
                        test = end[5:]
                        continue
                    if end == "else":
                        rest, _ = block("endif")
                    break
                out.append(("if", arms, rest))
            elif body == "generation":
                out.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown statement {body!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block()[0]


# Constant folding. ------------------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_CALC: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def fold(tree: tuple, filters: Mapping[str, Callable[[str], str]]) -> tuple:
    """The expression with every part that holds literals only replaced by its value."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        if tree[2] not in filters:
            raise TemplateError(f"unknown filter {tree[2]!r}")
        inner = fold(tree[1], filters)
        return ("const", filters[tree[2]](_text(inner[1]))) if inner[0] == "const" else ("filter", inner, tree[2])
    parts = [fold(t, filters) for t in tree[1:]]
    constant = all(p[0] == "const" for p in parts)
    if kind in _CALC and constant:
        return ("const", _CALC[kind](parts[0][1], parts[1][1]))
    if kind == "not" and constant:
        return ("const", not parts[0][1])
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold_block(block: list[tuple], filters: Mapping[str, Callable[[str], str]]) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text":
            if not node[1]:
                return
            if out and out[-1][0] == "text":
                node = ("text", out.pop()[1] + node[1])
        out.append(node)

    for node in block:
        kind = node[0]
        if kind == "put":
            tree = fold(node[1], filters)
            add(("text", _text(tree[1])) if tree[0] == "const" else ("put", tree))
        elif kind == "for":
            add(("for", node[1], fold(node[2], filters), fold_block(node[3], filters)))
        elif kind == "generation":
            add(("generation", fold_block(node[1], filters)))
        elif kind == "if":
            arms, rest = [], fold_block(node[2], filters)
            for test, inner in node[1]:
                test, inner = fold(test, filters), fold_block(inner, filters)
                if test[0] != "const":
                    arms.append((test, inner))
                elif test[1]:
                    rest = inner
                    break
            if arms:
                add(("if", arms, rest))
            else:
                for n in rest:
                    add(n)
        else:
            add(node)
    return out


# Closures. --------------------------------------------------------------------------------------------------------


def _expression(tree: tuple, filters: Mapping[str, Callable[[str], str]]) -> Expression:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "filter":
        inner, apply = _expression(tree[1], filters), filters[tree[2]]
        return lambda scope: apply(_text(inner(scope)))
    parts = [_expression(t, filters) for t in tree[1:]]
    if kind == "member":
        of, key = parts

        def member(scope: dict) -> Any:
            value = of(scope)
            return value.get(key(scope)) if isinstance(value, Mapping) else None

        return member
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    calc = _CALC[kind]
    return lambda scope: calc(parts[0](scope), parts[1](scope))


def _block(block: list[tuple], filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict, Output], None]:
    steps = [_statement(node, filters) for node in block]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _statement(node: tuple, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda scope, out, t=node[1]: out.write(t)
    if kind == "put":
        value = _expression(node[1], filters)
        return lambda scope, out: out.write(_text(value(scope)))
    if kind == "for":
        name, items, inner = node[1], _expression(node[2], filters), _block(node[3], filters)

        def loop(scope: dict, out: Output) -> None:
            own = dict(scope)
            for item in items(scope) or ():
                own[name] = item
                inner(own, out)

        return loop
    if kind == "if":
        arms = [(_expression(t, filters), _block(b, filters)) for t, b in node[1]]
        rest = _block(node[2], filters)

        def choose(scope: dict, out: Output) -> None:
            for test, inner in arms:
                if test(scope):
                    return inner(scope, out)
            rest(scope, out)

        return choose
    inner = _block(node[1], filters)

    def generation(scope: dict, out: Output) -> None:
        start = out.size
        inner(scope, out)
        out.spans.append((start, out.size))

    return generation


class Template:
    """A compiled template: ``render(context)`` gives the text and its generation spans (start, end), in code points."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[str], str]] | None = None):
        filters = dict(filters or {})
        self.tree = fold_block(parse(source), filters)
        self._run = _block(self.tree, filters)

    def render(self, context: Mapping[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self._run(dict(context), out)
        return "".join(out.parts), out.spans
