"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if expression %} .. {% else %} .. {% endif %}
    {% for turn in turns %} .. {% endfor %}   {% generation %} .. {% endgeneration %}

Expressions know string literals, true and false, the loop's name with .role and .text, loop.first,
the operators or, and, not, ==, !=, +, parentheses, and filters (`| escape`). There are no calls,
no other attributes and no Python underneath, so a template can neither reach nor loop over
anything but the turns it is given. The text is parsed into a tree, constant parts are folded, and
every node becomes a closure that yields pieces of output and the two generation marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum


class Mark(Enum):
    """Yielded where text under the loss mask begins and ends."""

    BEGIN = 1
    CLOSE = 2


class TemplateError(ValueError):
    pass


# Reversible escapes: after them no text holds <, > or a bare backslash, so no control string either.
_OUT = str.maketrans({"\\": "\\b", "<": "\\l", ">": "\\g"})
_LINE = str.maketrans({"\\": "\\b", "<": "\\l", ">": "\\g", "\n": "\\n", "\r": "\\r"})
_BACK = {"\\b": "\\", "\\l": "<", "\\g": ">", "\\n": "\n", "\\r": "\r"}
FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda s: s.translate(_OUT),
    "escape_line": lambda s: s.translate(_LINE),
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


def unescape(s: str) -> str:
    return re.sub(r"\\[blgnr]", lambda m: _BACK[m[0]], s)


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    sign: str
    parts: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[()|+.])|([A-Za-z_]\w*))")
_QUOTED = {"\\n": "\n", "\\t": "\t", "\\'": "'", '\\"': '"', "\\\\": "\\"}


class _Expression:
    """Precedence climbing over an expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(("text", m[1]) if m[1] else ("sign", m[2]) if m[2] else ("word", m[3]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "text":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        value = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.added()
        if sign := self.take("==", "!="):
            return Op(sign, (left, self.added()))
        return left

    def added(self):
        left = self.filtered()
        while self.take("+"):
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "word" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Op("|" + name, (value,))
        return value

    def atom(self):
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis stays open")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\.", lambda m: _QUOTED.get(m[0], m[0]), text[1:-1]))
        if kind == "word":
            if text in ("true", "false"):
                return Const(text == "true")
            path = [text]
            while self.take("."):
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
                    raise TemplateError("a name must follow the point")
                path.append(self.tokens[self.at][1])
                self.at += 1
            return Name(tuple(path))
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    stack: list[tuple[str, list, list | None, object]] = [("", [], None, None)]
    names: list[str] = []

    def checked(expression):
        def look(x):
            if isinstance(x, Name) and not (
                (len(x.path) == 2 and x.path[0] in names and x.path[1] in ("role", "text")) or (names and x.path == ("loop", "first"))
            ):
                raise TemplateError(f"no name {'.'.join(x.path)}")
            for p in x.parts if isinstance(x, Op) else ():
                look(p)

        look(expression)
        return expression

    for piece in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S):
        kind, body, no, extra = stack[-1]
        into = body if no is None else no
        if piece.startswith("{{"):
            into.append(Out(checked(_Expression(piece[2:-2]).whole())))
        elif piece.startswith("{%"):
            words = piece[2:-2].split(None, 1)
            head = words[0] if words else ""
            if head == "for":
                m = re.fullmatch(r"(\w+) in turns\s*", words[1] if len(words) > 1 else "")
                if not m or names:
                    raise TemplateError("only one loop, over turns, is there")
                names.append(m[1])
                stack.append(("for", [], None, m[1]))
            elif head == "if":
                stack.append(("if", [], None, checked(_Expression(words[1] if len(words) > 1 else "").whole())))
            elif head == "else" and kind == "if" and no is None:
                stack[-1] = (kind, body, [], extra)
            elif head == "generation":
                if any(s[0] == "generation" for s in stack):
                    raise TemplateError("generation marks don't nest")
                stack.append(("generation", [], None, None))
            elif head == "end" + kind and kind:
                stack.pop()
                node = For(extra, tuple(body)) if kind == "for" else Generation(tuple(body)) if kind == "generation" else If(extra, tuple(body), tuple(no or ()))
                if kind == "for":
                    names.pop()
                outer = stack[-1]
                (outer[1] if outer[2] is None else outer[2]).append(node)
            else:
                raise TemplateError(f"unexpected {piece}")
        elif piece:
            into.append(Out(Const(piece)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} stays open")
    return tuple(stack[0][1])


def _apply(sign: str, values: list):
    if sign == "not":
        return not values[0]
    if sign == "==":
        return values[0] == values[1]
    if sign == "!=":
        return values[0] != values[1]
    if sign == "+":
        return _shown(values[0]) + _shown(values[1])
    return FILTERS[sign[1:]](_shown(values[0]))


def _shown(x) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x).lower()


def fold(x):
    """A tree without the parts that are known beforehand."""
    if isinstance(x, Op):
        parts = tuple(fold(p) for p in x.parts)
        if x.sign in ("and", "or") and isinstance(parts[0], Const):
            return parts[1] if bool(parts[0].value) == (x.sign == "and") else parts[0]
        if x.sign not in ("and", "or") and all(isinstance(p, Const) for p in parts):
            return Const(_apply(x.sign, [p.value for p in parts]))
        return Op(x.sign, parts)
    if isinstance(x, tuple):
        out: list = []
        for node in x:
            if isinstance(node, Out):
                node = Out(fold(node.value))
                if isinstance(node.value, Const):
                    node = Out(Const(_shown(node.value.value)))
                    if not node.value.value:
                        continue
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(out[-1].value.value + node.value.value))
                        continue
                out.append(node)
            elif isinstance(node, If):
                test = fold(node.test)
                if isinstance(test, Const):
                    out = list(fold((*out, *(node.yes if test.value else node.no))))
                else:
                    out.append(If(test, fold(node.yes), fold(node.no)))
            else:
                out.append(For(node.name, fold(node.body)) if isinstance(node, For) else Generation(fold(node.body)))
        return tuple(out)
    return x


def _expression(x) -> Callable[[dict], object]:
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):
        if x.path == ("loop", "first"):
            return lambda env: env["loop"]
        place = 0 if x.path[1] == "role" else 1
        return lambda env, n=x.path[0]: env[n][place]
    parts = [_expression(p) for p in x.parts]
    if x.sign == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if x.sign == "or":
        return lambda env: parts[0](env) or parts[1](env)
    if x.sign.startswith("|"):
        change, part = FILTERS[x.sign[1:]], parts[0]
        return lambda env: change(_shown(part(env)))
    return lambda env: _apply(x.sign, [p(env) for p in parts])


def _block(nodes: tuple) -> Callable[[dict], Iterator]:
    made = [_node(n) for n in nodes]

    def run(env):
        for m in made:
            yield from m(env)

    return run


def _node(x) -> Callable[[dict], Iterator]:
    if isinstance(x, Out):
        if isinstance(x.value, Const):
            return lambda env, v=(x.value.value,): v
        value = _expression(x.value)
        return lambda env: (_shown(value(env)),)
    if isinstance(x, If):
        test, yes, no = _expression(x.test), _block(x.yes), _block(x.no)
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(x, Generation):
        body = _block(x.body)

        def marked(env):
            yield Mark.BEGIN
            yield from body(env)
            yield Mark.CLOSE

        return marked
    body = _block(x.body)

    def loop(env):
        inner = dict(env)
        for i, turn in enumerate(env["turns"]):
            inner[x.name], inner["loop"] = turn, i == 0
            yield from body(inner)

    return loop


def compiled(source: str) -> Callable[[Iterator[tuple[str, str]]], Iterator]:
    """A function from turns (role, text), which may come one by one, to pieces of output and marks."""
    body = _block(fold(parse(source)))
    return lambda turns: body({"turns": turns})
