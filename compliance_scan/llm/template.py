"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                      output
    {% for x in expression %} ... {% endfor %}   with loop.index0, loop.first, loop.last
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set x = expression %}
    {% generation %} ... {% endgeneration %}     output inside is a model's own text
    {# comment #}                         and a dash inside a tag ({%- -%}) strips white space

Expressions know strings, integers, true, false, none, names, ``a.b`` and
``a['b']`` on mappings, ``|filter``, ``+ == != < > in not and or``, and
parentheses.  There are no calls and no Python attributes, so a template
reaches only the values and filters it is given.

``compile_template`` parses to a tree of tuples, folds constant parts (also
adjacent literal text and branches with a constant condition) and turns every
node into a closure.  Rendering is a generator of ``(text, generated)``
pieces; loops pull their values one by one, so a conversation of any length is
rendered in constant memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Piece = tuple[str, bool]
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[<>+|.()\[\]]))")
_ESCAPED = {"n": "\n", "t": "\t"}
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


# --- parsing -------------------------------------------------------------------


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        number, quoted, name, sign = m.groups()
        if number:
            out.append(("value", int(number)))
        elif quoted:
            out.append(("value", re.sub(r"\\(.)", lambda x: _ESCAPED.get(x[1], x[1]), quoted[1:-1], flags=re.S)))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples headed by their kind."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def parse(self) -> tuple:
        node = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "value" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, sign: str) -> None:
        if not self._take(sign):
            raise TemplateError(f"expected {sign!r}")

    def _name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def _or(self) -> tuple:
        node = self._and()
        while self._take("or"):
            node = ("or", node, self._and())
        return node

    def _and(self) -> tuple:
        node = self._not()
        while self._take("and"):
            node = ("and", node, self._not())
        return node

    def _not(self) -> tuple:
        return ("not", self._not()) if self._take("not") else self._compared()

    def _compared(self) -> tuple:
        node = self._sum()
        while sign := self._take("==", "!=", "<", ">", "in"):
            node = (sign, node, self._sum())
        return node

    def _sum(self) -> tuple:
        node = self._postfix()
        while self._take("+"):
            node = ("+", node, self._postfix())
        return node

    def _postfix(self) -> tuple:
        node = self._atom()
        while sign := self._take(".", "[", "|"):
            if sign == ".":
                node = ("get", node, ("value", self._name()))
            elif sign == "|":
                node = ("filter", node, self._name())
            else:
                node = ("get", node, self._or())
                self._need("]")
        return node

    def _atom(self) -> tuple:
        if self._take("("):
            node = self._or()
            self._need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        if kind == "value":
            return ("value", value)
        return ("value", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(text | output | tag, content) in order, white space stripped where a tag asks for it."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m[0][2] == "-" else text))
        if m[1] is not None:
            out.append(("output", m[1]))
        elif m[2] is not None:
            out.append(("tag", m[2].strip()))
        at, strip = m.end(), m[0][-3] == "-"
    out.append(("text", source[at:].lstrip() if strip else source[at:]))
    return [p for p in out if p != ("text", "")]


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of statement nodes."""
    pieces, at = _pieces(source), 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(("text", content))
                continue
            if kind == "output":
                nodes.append(("output", _Expression(content).parse()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return nodes, content
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {content!r}")
                nodes.append(("for", m[1], _Expression(m[2]).parse(), block("endfor")[0]))
            elif word == "if":
                nodes.append(branch(rest))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {content!r}")
                nodes.append(("set", m[1], _Expression(m[2]).parse()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {content!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    def branch(condition: str) -> tuple:
        yes, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", _Expression(condition).parse(), yes, [branch(end[4:])])
        no = block("endif")[0] if end == "else" else []
        return ("if", _Expression(condition).parse(), yes, no)

    return block()[0]


# --- folding ---------------------------------------------------------------------


def _fold_expression(node: tuple, filters: dict[str, Callable]) -> tuple:
    kind = node[0]
    if kind in ("value", "name"):
        return node
    parts = tuple(_fold_expression(p, filters) if isinstance(p, tuple) else p for p in node[1:])
    node = (kind, *parts)
    if all(p[0] == "value" for p in parts if isinstance(p, tuple)):
        return ("value", _closure(node, filters)({}))
    return node


def fold(nodes: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """The tree with constant expressions, constant branches and adjacent texts put together."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "output":
            value = _fold_expression(node[1], filters)
            new = [("text", _text(value[1]))] if value[0] == "value" else [("output", value)]
        elif kind == "if":
            condition = _fold_expression(node[1], filters)
            yes, no = fold(node[2], filters), fold(node[3], filters)
            new = (yes if condition[1] else no) if condition[0] == "value" else [("if", condition, yes, no)]
        elif kind == "for":
            new = [("for", node[1], _fold_expression(node[2], filters), fold(node[3], filters))]
        elif kind == "set":
            new = [("set", node[1], _fold_expression(node[2], filters))]
        elif kind == "generation":
            new = [("generation", fold(node[1], filters))]
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


# --- closures --------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _get(value: Any, key: Any) -> Any:
    if not isinstance(value, dict):
        raise TemplateError(f"{key!r} is asked of something that is no mapping")
    return value.get(key)


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "in": lambda a, b: a in b, "get": _get,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
}


def _closure(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "value":
        return lambda names, value=node[1]: value
    if kind == "name":
        return lambda names, name=node[1]: names.get(name)
    if kind == "filter":
        if node[2] not in filters:
            raise TemplateError(f"unknown filter {node[2]!r}")
        return lambda names, of=_closure(node[1], filters), f=filters[node[2]]: f(of(names))
    a = _closure(node[1], filters)
    if kind == "not":
        return lambda names: not a(names)
    b = _closure(node[2], filters)
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    return lambda names, f=_OPERATORS[kind]: f(a(names), b(names))


def _numbered(values: Iterable) -> Iterator[tuple[Any, dict]]:
    """Each value with its ``loop``; reads one value ahead to know the last."""
    none = object()
    values = iter(values)
    value, i = next(values, none), 0
    while value is not none:
        following = next(values, none)
        yield value, {"index0": i, "first": i == 0, "last": following is none}
        value, i = following, i + 1


def _body(nodes: list[tuple], filters: dict[str, Callable], generated: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, filters, generated) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(names)

    return run


def _step(node: tuple, filters: dict[str, Callable], generated: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], generated)
        return lambda names: iter((piece,))
    if kind == "output":
        value = _closure(node[1], filters)
        return lambda names: iter(((_text(value(names)), generated),))
    if kind == "set":
        value = _closure(node[2], filters)

        def assign(names: dict) -> Iterator[Piece]:
            names[node[1]] = value(names)
            return iter(())

        return assign
    if kind == "generation":
        return _body(node[1], filters, True)
    if kind == "if":
        condition = _closure(node[1], filters)
        yes, no = _body(node[2], filters, generated), _body(node[3], filters, generated)
        return lambda names: (yes if condition(names) else no)(names)
    values, body = _closure(node[2], filters), _body(node[3], filters, generated)

    def repeat(names: dict) -> Iterator[Piece]:
        for value, loop in _numbered(values(names) or ()):
            yield from body({**names, node[1]: value, "loop": loop})

    return repeat


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v),
}


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """``render(name=value, ...)`` -> iterator of ``(text, generated)``."""
    known = FILTERS | (filters or {})
    run = _body(fold(parse(source), known), known, False)
    return lambda **names: run(dict(names))
