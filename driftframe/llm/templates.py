"""A compiler of sandboxed chat templates.

The language: ``{{ expression }}``, ``{% for x in e %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = e %}``, ``{% generation %}...{% endgeneration %}``, ``{# comment #}`` and ``-`` next to a
delimiter to trim white space. Expressions: strings, integers, true, false, none, names, ``a.b`` and
``a['b']`` (keys of mappings only), filters, ``not and or == != < <= > >= in + ~`` and ``a if c else b``.
There are no calls and no access to Python attributes; names that start with ``_`` are refused.

A template is parsed to a syntax tree, constants are folded, and the tree becomes Python closures that
yield (text, generated) pieces. Loops pull their items one at a time, so a conversation is rendered as
it comes; the text between generation markers is what a model would have written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

CONTROL = "\\#<:"
_ESCAPE = str.maketrans({c: "\\" + c for c in CONTROL})
_UNESCAPE = re.compile(r"\\(.)", re.S)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    r"""A backslash before each of \ # < : so that no control string occurs in the result."""
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _text(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "title": lambda v: _text(v).title(), "trim": lambda v: _text(v).strip(), "length": lambda v: len(v), "string": _text,
}


# -- syntax tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- parsing -------------------------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(\d+)|('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>.\[\]()|,=]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_STOPS = {"for", "in", "if", "else", "not", "and", "or"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKENS.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            at = m.end()
            self.tokens.append(("int", int(m[1])) if m[1] else ("str", _literal(m[2])) if m[2] else ("name", m[3]) if m[3] else ("op", m[4]))
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing at {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value in _STOPS or value in _WORDS:
            raise TemplateError(f"a name is missing at {value!r}")
        if value.startswith("_"):
            raise TemplateError(f"{value!r}: such names are refused")
        self.at += 1
        return value

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self):
        value = self.choice()
        self.done()
        return value

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const(None)
            return Op("choose", (test, value, other))
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Op("or", (value, self.both()))
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Op("and", (value, self.negated()))
        return value

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            value = Op(op, (value, self.joined()))
        return value

    def joined(self):
        value = self.filtered()
        while op := self.take("+", "-", "~"):
            value = Op(op, (value, self.filtered()))
        return value

    def filtered(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = Key(value, Const(self.name()))
            elif self.take("["):
                value = Key(value, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = Filter(name, value)
            else:
                return value

    def atom(self):
        kind, value = self.peek()
        if kind in ("int", "str"):
            self.at += 1
            return Const(value)
        if kind == "name" and value in _WORDS:
            self.at += 1
            return Const(_WORDS[value])
        if self.take("("):
            inner = self.choice()
            self.need(")")
            return inner
        return Name(self.name())


def _literal(source: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), source[1:-1], flags=re.S)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, trim = [], False
    for part in _PARTS.split(source):
        if part[:2] in ("{{", "{%"):
            if part[2] == "-" and parts and parts[-1][0] == "text":
                parts[-1] = ("text", parts[-1][1].rstrip())
            trim = part[-3] == "-"
            parts.append((part[:2], part[2:-2].removeprefix("-").removesuffix("-").strip()))
        elif part[:2] != "{#":
            parts.append(("text", part.lstrip() if trim else part))
            trim = trim and not part.strip()
    body, rest, end = _body(parts, 0, ())
    return body


def _body(parts: list, at: int, ends: tuple) -> tuple[tuple, int, str]:
    out = []
    while at < len(parts):
        kind, content = parts[at]
        at += 1
        if kind == "text":
            if content:
                out.append(Out(Const(content)))
            continue
        if kind == "{{":
            out.append(Out(_Expression(content).whole()))
            continue
        word, _, rest = content.partition(" ")
        if word in ends:
            return tuple(out), at, content
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            over = e.whole()
            body, at, _ = _body(parts, at, ("endfor",))
            out.append(For(name, over, body))
        elif word == "if":
            node, at = _branches(rest, parts, at)
            out.append(node)
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            out.append(Set(name, e.whole()))
        elif word == "generation":
            body, at, _ = _body(parts, at, ("endgeneration",))
            out.append(Generation(body))
        else:
            raise TemplateError(f"unknown tag {content!r}")
    if ends:
        raise TemplateError(f"no {ends[-1]}")
    return tuple(out), at, ""


def _branches(test: str, parts: list, at: int) -> tuple[If, int]:
    then, at, end = _body(parts, at, ("elif", "else", "endif"))
    other: tuple = ()
    if end.startswith("elif"):
        node, at = _branches(end.partition(" ")[2], parts, at)
        other = (node,)
    elif end == "else":
        other, at, _ = _body(parts, at, ("endif",))
    return If(_Expression(test).whole(), then, other), at


# -- folding -------------------------------------------------------------------------------------


def fold(node):
    """The tree with constant expressions computed, dead branches gone and adjacent texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Out) and isinstance(y.value, Const):
                    y = Out(Const(_text(y.value.value)))
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        y = Out(Const(out.pop().value.value + y.value.value))
                    if not y.value.value:
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, (Key, Filter)):
        of = fold(node.of)
        node = Key(of, fold(node.key)) if isinstance(node, Key) else Filter(node.name, of)
        return Const(_expression(node)({})) if isinstance(node, Filter) and isinstance(of, Const) else node
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("choose", "and", "or") and isinstance(args[0], Const):
            return (args[1] if args[0].value else args[2]) if node.op == "choose" else args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Const(_expression(Op(node.op, args))({})) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# -- closures ------------------------------------------------------------------------------------


def _add(a, b):
    if isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str):
        return a + b
    raise TemplateError("+ takes two strings or two integers")


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": _add, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b),
}


def _expression(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env):
            if name not in env:
                raise TemplateError(f"{name!r} is undefined")
            return env[name]

        return look
    if isinstance(node, Key):
        of, key = _expression(node.of), _expression(node.key)

        def get(env):
            value, at = of(env), key(env)
            if not isinstance(value, Mapping):
                raise TemplateError(f"{at!r}: only mappings have keys")
            return value.get(at)

        return get
    if isinstance(node, Filter):
        f, of = FILTERS[node.name], _expression(node.of)
        return lambda env: f(of(env))
    args = [_expression(a) for a in node.args]
    if node.op == "not":
        return lambda env: not args[0](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.op == "choose":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    f, a, b = _BINARY[node.op], *args
    return lambda env: f(a(env), b(env))


Piece = tuple[str, bool]


def _statement(node, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, tuple):
        steps = [_statement(x, generated) for x in node]

        def run(env):
            for step in steps:
                yield from step(env)

        return run
    if isinstance(node, Out):
        value = _expression(node.value)

        def out(env):
            yield _text(value(env)), generated

        return out
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value)

        def put(env):
            env[name] = value(env)
            return iter(())

        return put
    if isinstance(node, If):
        test, then, other = _expression(node.test), _statement(node.then, generated), _statement(node.other, generated)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Generation):
        return _statement(node.body, True)
    over, body, name = _expression(node.over), _statement(node.body, generated), node.name

    def loop(env):
        items, k, nothing = iter(over(env)), 0, object()
        item = next(items, nothing)
        while item is not nothing:
            following = next(items, nothing)
            k += 1
            yield from body({**env, name: item, "loop": {"index": k, "first": k == 1, "last": following is nothing}})
            item = following

    return loop


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _statement(self.tree, False)

    def stream(self, **names: Any) -> Iterator[Piece]:
        """(text, generated) pieces; iterables among ``names`` are consumed as the output is."""
        return (p for p in self._run(dict(names)) if p[0])

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans between generation markers, in code points; adjacent ones stay apart if text of another marker pair."""
        return join(self.stream(**names))


def join(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for text, generated in pieces:
        if generated:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        parts.append(text)
        at += len(text)
    return "".join(parts), spans
