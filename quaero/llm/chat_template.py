"""Conversations through a template compiler.

The template language has text, ``{{ expression }}``, ``for``, ``if``, ``set`` and ``generation`` blocks. It is parsed to a syntax
tree, constants are folded, and each node becomes a Python closure; there is no ``eval``, no attribute of a Python object can be reached,
and the only calls are the filters listed here. What is rendered inside ``generation`` is marked as spans of the output, the
loss mask.

Texts may contain the template's control strings. The ``escape`` filter doubles backslashes and puts one behind the first character
of every control string, so none is left in a text, and ``unescape`` undoes exactly that.

Conversations are gathered by one shuffle on their id, sorted by turn inside the partition and rendered as they stream by, so
a task holds one conversation at a time.

Defined results: null roles and texts are empty strings; rows with one turn number are ordered by role, then text; null turns come
first; a null id is a conversation of its own; rows of other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: The control strings of the default template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<s>[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>"
    "{% endif %}{% endfor %}"
)

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda x: escape(str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": lambda x: len(x) if isinstance(x, str | list | dict) else 0,
}


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for something outside the language."""


# Syntax tree ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: object


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition or None, body)


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_LEXEME = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|.()\[\]]))")
_WORDS = {"and", "or", "not", "in", "true", "false", "none", "if", "else"}


def _lex(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*found, ("end", "")]


class _Expression:
    """Precedence climbing over one expression's lexemes."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-"))

    def __init__(self, source: str) -> None:
        self.lexemes = _lex(source)
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.lexemes[self.at]

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.lexemes[self.at]
        if value is not None and got[1] != value:
            raise TemplateError(f"expected {value!r}, found {got[1]!r}")
        self.at += 1
        return got

    def whole(self) -> object:
        value = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return value

    def level(self, k: int) -> object:
        if k == len(self.LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in self.LEVELS[k]:
            op = self.take()[1]
            left = Apply(op, (left, self.level(k + 1)))
        return left

    def unary(self) -> object:
        if self.peek() == ("name", "not"):
            self.take()
            return Apply("not", (self.level(2),))
        return self.filtered()

    def filtered(self) -> object:
        value = self.atom()
        while self.peek()[1] in ("|", ".", "[") and self.peek()[0] == "op":
            op = self.take()[1]
            if op == "|":
                name = self.take()[1]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = Apply("|" + name, (value,))
            elif op == ".":
                kind, name = self.take()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                value = Field(value, Const(name))
            else:
                value = Field(value, self.level(0))
                self.take("]")
        return value

    def atom(self) -> object:
        kind, text = self.take()
        if kind == "num":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if text == "(":
            value = self.level(0)
            self.take(")")
            return value
        if kind == "name" and text in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[text])
        if kind == "name" and text not in _WORDS and not text.startswith("_"):
            return Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    body, rest, end = _block(parts, 0, ())
    if end:
        raise TemplateError(f"unexpected {end}")
    return body


def _block(parts: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[tuple, int, str]:
    """(nodes, index behind the closing tag, that tag)."""
    nodes: list = []
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if kind == "text":
            nodes.append(Text(text))
        elif kind == "out":
            nodes.append(Output(_Expression(text).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in until:
                return tuple(nodes), at, text
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {text!r}")
                body, at, _ = _block(parts, at, ("endfor",))
                nodes.append(For(m[1], _Expression(m[2]).whole(), body))
            elif word == "if":
                branches, condition = [], _Expression(rest).whole()
                while True:
                    body, at, end = _block(parts, at, ("elif", "else", "endif"))
                    branches.append((condition, body))
                    if end.startswith("endif"):
                        break
                    condition = _Expression(end.partition(" ")[2]).whole() if end.startswith("elif") else None
                nodes.append(If(tuple(branches)))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"cannot read {text!r}")
                nodes.append(Assign(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                body, at, _ = _block(parts, at, ("endgeneration",))
                nodes.append(Generation(body))
            else:
                raise TemplateError(f"no tag {word!r}")
    if until:
        raise TemplateError(f"no {until[-1]}")
    return tuple(nodes), at, ""


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "-": lambda a, b: a - b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}", "not": lambda a: not a,
}


def fold(node: object) -> object:
    """The tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif x != Text(""):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            f = FILTERS[node.op[1:]] if node.op[0] == "|" else _OPERATIONS[node.op]
            return Const(f(*(a.value for a in args)))
        return Apply(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of), fold(node.name))
    if isinstance(node, Output):
        value = fold(node.value)
        return Text(_shown(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, If):
        kept = []
        for condition, body in node.branches:
            condition = None if condition is None else fold(condition)
            if isinstance(condition, Const):
                if not condition.value:
                    continue
                condition = None
            kept.append((condition, fold(body)))
            if condition is None:
                break
        return kept[0][1] if kept and kept[0][0] is None else If(tuple(kept)) if kept else ()
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _shown(value: object) -> str:
    return "" if value is None else str(value)


# Closures ------------------------------------------------------------------------------------------------------------


class Output_(list):
    """Rendered pieces, and the spans of the output that were generated."""

    def __init__(self) -> None:
        self.size, self.depth, self.spans = 0, 0, []

    def put(self, text: str) -> None:
        if text:
            self.append(text)
            if self.depth:
                if self.spans and self.spans[-1][1] == self.size and self.open_:
                    self.spans[-1][1] += len(text)
                else:
                    self.spans.append([self.size, self.size + len(text)])
                    self.open_ = True
            self.size += len(text)

    open_ = False


def _value(node: object) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Field):
        of, name = _value(node.of), _value(node.name)

        def field(scope: dict) -> object:
            data, key = of(scope), name(scope)
            if isinstance(data, dict):
                return data.get(key)
            if isinstance(data, str | list) and isinstance(key, int) and -len(data) <= key < len(data):
                return data[key]
            return None

        return field
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = FILTERS[node.op[1:]] if node.op[0] == "|" else _OPERATIONS[node.op]
    if len(args) == 1:
        return lambda scope: f(args[0](scope))
    return lambda scope: f(args[0](scope), args[1](scope))


def _run(node: object) -> Callable[[dict, Output_], None]:
    if isinstance(node, tuple):
        steps = [_run(n) for n in node]

        def run(scope: dict, out: Output_) -> None:
            for step in steps:
                step(scope, out)

        return run
    if isinstance(node, Text):
        return lambda scope, out, t=node.text: out.put(t)
    if isinstance(node, Output):
        shown = _value(node.value)
        return lambda scope, out: out.put(_shown(shown(scope)))
    if isinstance(node, Assign):
        assigned = _value(node.value)
        return lambda scope, out: scope.__setitem__(node.name, assigned(scope))
    if isinstance(node, If):
        branches = [(None if c is None else _value(c), _run(b)) for c, b in node.branches]

        def choose(scope: dict, out: Output_) -> None:
            for condition, body in branches:
                if condition is None or condition(scope):
                    return body(scope, out)
            return None

        return choose
    if isinstance(node, Generation):
        inner = _run(node.body)

        def generate(scope: dict, out: Output_) -> None:
            out.depth += 1
            out.open_ = out.open_ and out.depth > 1
            inner(scope, out)
            out.depth -= 1

        return generate
    over, body, name = _value(node.over), _run(node.body), node.name

    def loop(scope: dict, out: Output_) -> None:
        items = iter(over(scope) or ())
        inner, index = dict(scope), 0
        item = next(items, loop)
        while item is not loop:
            following = next(items, loop)
            inner[name] = item
            inner["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": following is loop}
            body(inner, out)
            item, index = following, index + 1

    return loop


class Template:
    def __init__(self, source: str = DEFAULT_TEMPLATE) -> None:
        self.tree = fold(parse(source))
        self._run = _run(self.tree)

    def render(self, messages: Iterable[dict], **more: object) -> tuple[str, list[list[int]]]:
        """The output, and the spans of it (in code points) that are under the loss mask."""
        out = Output_()
        self._run({"messages": messages, **more}, out)
        return "".join(out), out.spans


_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|<s>\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of an output of the default template."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["text"])))
        else:
            turns.append(("user", unescape(m["user"])) if m["user"] is not None else ("assistant", unescape(m["assistant"])))
        at = m.end()
    return turns


def format_conversations(rows: DataFrame, source: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, formatted, mask): each conversation's output and its spans under the loss mask."""
    Template(source)  # errors show here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        each = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        ids, texts, masks, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            spans = pa.array([[{"start": a, "end": z} for a, z in m] for m in masks], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), spans], ["conv_id", "formatted", "mask"])

        for conv, turns in groupby(each, key=lambda r: r[0]):
            text, spans = template.render({"role": role or "", "text": said or ""} for _, role, said in turns)
            ids.append(conv)
            texts.append(text)
            masks.append(spans)
            size += len(text)
            if size > 1 << 20:
                yield batch()
                ids, texts, masks, size = [], [], [], 0
        if ids:
            yield batch()

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, mask array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the outputs and masks say when read back: turns, and the text under the mask."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, mask in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
