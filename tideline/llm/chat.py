"""Chat formatting: templates compiled to Python closures, rendered over streams of turns, and read back.

A template is text with ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %} {% elif %} {% else %}``,
``{% set name = expression %}``, ``{% generation %}`` (what a model learns to write) and ``{# remarks #}``; a dash inside
a brace trims white space. Expressions know texts, whole numbers, ``true false none``, names, the fields of a message,
``loop.first last index index0``, ``or and not == != in + ~``, ``a if c else b`` and the filters of ``FILTERS``. There is
no call, no attribute of a Python object and no loop but the one over the messages: a template can only make text.

:func:`compile_template` parses it to a tree, folds what is constant (expressions, branches, neighbouring text) and
makes one closure of each node. The closures are generators: they draw one message after the other and give out pieces
of text and the marks of generation spans, so a conversation of any length passes through in bounded memory.

Control strings inside texts are escaped by a backslash after their first character (after any backslashes that already
stand there); other text stays as it is, and taking one backslash away again gives the text back. A set of control
strings must allow that: none holds a first character, or a backslash, beyond its beginning.

On Spark the turns are dealt out by conversation and sorted, and each task renders its stream: a conversation leaves as
parts of about ``PART_CHARS`` characters, cut between turns. Memory is one batch and one part, also where one
conversation holds a third of all rows; that one takes one task, because its digest is one chain of bytes.

Edges: a null text or role is empty; rows without a conversation id are one conversation; turns sort nulls first, ties by
role, then text, and repeated rows are turns of their own. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from enum import Enum
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 20
#: Rows of an outgoing batch, and the characters after which it goes out earlier.
BATCH_ROWS, BATCH_CHARS = 500, 1 << 22


class TemplateError(ValueError):
    """A template that does not parse, or that does what templates may not."""


class Mark(Enum):
    """What a rendering gives out besides text."""

    OPEN, CLOSE, TURN = "open", "close", "turn"


OPEN, CLOSE, TURN = Mark


class Controls:
    """Control strings, and the reversible escape for texts that hold them."""

    def __init__(self, strings: Iterable[str]):
        self.strings = tuple(dict.fromkeys(strings))
        heads = {s[:1] for s in self.strings}
        if any(len(s) < 2 or "\\" in s or heads & set(s[1:]) for s in self.strings):
            raise TemplateError("control strings need two characters, and no backslash or first character of one of them beyond their beginning")
        by_head = {h: "|".join(re.escape(s[1:]) for s in self.strings if s[:1] == h) for h in sorted(heads)}
        both = "|".join(rf"{re.escape(h)}\\*(?=(?:{rest}))" for h, rest in by_head.items())
        once = "|".join(rf"{re.escape(h)}\\+(?=(?:{rest}))" for h, rest in by_head.items())
        self._escape = re.compile(both) if both else None
        self._unescape = re.compile(once) if once else None
        self.any = re.compile("|".join(map(re.escape, sorted(self.strings, key=len, reverse=True)))) if both else None

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0] + "\\", text) if self._escape else text

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][:-1], text) if self._unescape else text


# ---- syntax tree -------------------------------------------------------------------------------------------------


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: Any
    name: str


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Text:
    value: Any  # an expression


@dataclass
class If:
    test: Any
    then: list
    other: list


@dataclass
class For:
    name: str
    body: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_WORD = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+~|.()\[\]=]))""", re.S)
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"or", "and", "not", "in", "if", "else", "elif", "for", "set", "generation", "messages", "loop"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


#: What may stand behind a bar; ``escape`` is added by the compiler, for the template's own control strings.
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _shown(v).strip(),
    "upper": lambda v: _shown(v).upper(),
    "lower": lambda v: _shown(v).lower(),
    "capitalize": lambda v: _shown(v).capitalize(),
    "length": lambda v: len(_shown(v)),
    "string": _shown,
}


class _Expressions:
    """Expressions from the words of a tag, loosest first: choice, or, and, not, comparison, sum, filter, field."""

    def __init__(self, source: str):
        self.words: list[tuple[str, Any]] = []
        at = 0
        while source[at:].strip():
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:].strip()[:30]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.words.append(("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif number is not None:
                self.words.append(("number", int(number)))
            else:
                self.words.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] in ("name", "sign") and self.words[self.at][1] in wanted:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self._next(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name" or self.words[self.at][1] in _RESERVED | set(_CONSTANTS):
            raise TemplateError("a name expected")
        self.at += 1
        return self.words[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")

    def choice(self) -> Any:
        value = self._chain(("or",), lambda: self._chain(("and",), self._negation))
        if self._next("if"):
            test = self._chain(("or",), lambda: self._chain(("and",), self._negation))
            other = self.choice() if self._next("else") else Const(None)
            return Op("choice", [test, value, other])
        return value

    def _chain(self, signs: tuple[str, ...], part: Callable[[], Any]) -> Any:
        value = part()
        while sign := self._next(*signs):
            value = Op(sign, [value, part()])
        return value

    def _negation(self) -> Any:
        if self._next("not"):
            return Op("not", [self._negation()])
        value = self._sum()
        if sign := self._next("==", "!=", "in"):
            return Op(sign, [value, self._sum()])
        if self._next("not"):
            self.need("in")
            return Op("not", [Op("in", [value, self._sum()])])
        return value

    def _sum(self) -> Any:
        return self._chain(("+", "~"), self._filtered)

    def _filtered(self) -> Any:
        value = self._one()
        while self._next("|"):
            value = Op("filter", [value, self.name()])
        return value

    def _one(self) -> Any:
        if self.at >= len(self.words):
            raise TemplateError("an expression expected")
        kind, word = self.words[self.at]
        self.at += 1
        if kind in ("text", "number"):
            return Const(word)
        if word == "(":
            value = self.choice()
            self.need(")")
        elif kind == "name" and word in _CONSTANTS:
            return Const(_CONSTANTS[word])
        elif kind == "name" and (word == "loop" or word not in _RESERVED):
            value = Name(word)
        else:
            raise TemplateError(f"unexpected {word!r}")
        while sign := self._next(".", "["):
            if sign == ".":
                if self.at >= len(self.words) or self.words[self.at][0] != "name":
                    raise TemplateError("a field expected")
                value = Field(value, self.words[self.at][1])
                self.at += 1
            else:
                if self.at >= len(self.words) or self.words[self.at][0] != "text":
                    raise TemplateError("a field in quotes expected")
                value = Field(value, self.words[self.at][1])
                self.at += 1
                self.need("]")
        return value


def parse(source: str) -> list:
    """The syntax tree of a template: a list of nodes."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at, trim = 0, False

    def literal(text: str, before: bool) -> None:
        text = text.lstrip() if trim else text
        text = text.rstrip() if before else text
        if text:
            stack[-1][2].append(Text(Const(text)))

    for m in _TAG.finditer(source):
        literal(source[at : m.start()], bool(m[1] or m[4] or m[7]))
        at, trim = m.end(), bool(m[3] or m[6] or m[8])
        if m[2] is not None:
            words = _Expressions(m[2])
            stack[-1][2].append(Text(words.choice()))
            words.end()
        elif m[5] is not None:
            _statement(m[5].strip(), stack)
    literal(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0][2]


def _statement(source: str, stack: list) -> None:
    head, _, rest = source.partition(" ")
    words = _Expressions(rest)
    body = stack[-1][2]
    if head == "for":
        if any(kind == "for" for kind, _, _ in stack):
            raise TemplateError("a loop inside a loop")
        node = For(words.name(), [])
        words.need("in")
        words.need("messages")
        body.append(node)
        stack.append(("for", node, node.body))
    elif head == "if":
        node = If(words.choice(), [], [])
        body.append(node)
        stack.append(("if", node, node.then))
    elif head in ("elif", "else") and stack[-1][0] == "if":
        kind, node, _ = stack.pop()
        if head == "elif":
            inner = If(words.choice(), [], [])
            node.other.append(inner)
            stack.append(("if", inner, inner.then))
        else:
            stack.append(("else", node, node.other))
    elif head == "set":
        name = words.name()
        words.need("=")
        body.append(Set(name, words.choice()))
    elif head == "generation":
        if any(kind == "generation" for kind, _, _ in stack):
            raise TemplateError("a generation inside a generation")
        node = Generation([])
        body.append(node)
        stack.append(("generation", node, node.body))
    elif head.startswith("end") and stack[-1][0] in ({"if", "else"} if head == "endif" else {head[3:]} - {""}):
        stack.pop()
    else:
        raise TemplateError(f"unexpected {head!r}")
    words.end()


# ---- folding -----------------------------------------------------------------------------------------------------


def _value(kind: str, args: list) -> Any:
    if kind == "+":
        a, b = args
        if isinstance(a, int) and isinstance(b, int):
            return a + b
        return _shown(a) + _shown(b)
    if kind == "~":
        return _shown(args[0]) + _shown(args[1])
    if kind == "==":
        return args[0] == args[1]
    if kind == "!=":
        return args[0] != args[1]
    if kind == "in":
        return _shown(args[0]) in _shown(args[1])
    if kind == "not":
        return not args[0]
    raise TemplateError(f"unknown {kind!r}")


def fold_expression(node: Any, filters: dict[str, Callable]) -> Any:
    """The same expression with every constant part worked out."""
    if isinstance(node, Field):
        return Field(fold_expression(node.of, filters), node.name)
    if not isinstance(node, Op):
        return node
    if node.kind == "filter":
        if node.args[1] not in filters:
            raise TemplateError(f"unknown filter {node.args[1]!r}")
        value = fold_expression(node.args[0], filters)
        return Const(filters[node.args[1]](value.value)) if isinstance(value, Const) else Op("filter", [value, node.args[1]])
    args = [fold_expression(a, filters) for a in node.args]
    first = args[0]
    if node.kind == "choice":
        return (args[1] if first.value else args[2]) if isinstance(first, Const) else Op("choice", args)
    if node.kind in ("or", "and"):
        if isinstance(first, Const):
            return first if bool(first.value) == (node.kind == "or") else args[1]
        return Op(node.kind, args)
    return Const(_value(node.kind, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(node.kind, args)


def fold(nodes: list, filters: dict[str, Callable]) -> list:
    """The same tree with constant expressions worked out, dead branches gone and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Text):
            value = fold_expression(node.value, filters)
            if isinstance(value, Const):
                value = Const(_shown(value.value))
                if not value.value:
                    continue
                if out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const):
                    out[-1] = Text(Const(out[-1].value.value + value.value))
                    continue
            out.append(Text(value))
        elif isinstance(node, If):
            test, then, other = fold_expression(node.test, filters), fold(node.then, filters), fold(node.other, filters)
            if not isinstance(test, Const):
                out.append(If(test, then, other))
            else:
                for x in then if test.value else other:
                    joins = isinstance(x, Text) and isinstance(x.value, Const) and out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const)
                    if joins:
                        out[-1] = Text(Const(out[-1].value.value + x.value.value))
                    else:
                        out.append(x)
        elif isinstance(node, For):
            out.append(For(node.name, fold(node.body, filters)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body, filters)))
        else:
            out.append(Set(node.name, fold_expression(node.value, filters)))
    return out


# ---- closures ----------------------------------------------------------------------------------------------------

Scope = dict[str, Any]


def _expression(node: Any, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    """A closure that works out an expression in a scope."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, name = _expression(node.of, filters), node.name

        def look(scope: Scope) -> Any:
            held = of(scope)
            return held.get(name) if type(held) is dict else None  # a Python object has no fields here

        return look
    if node.kind == "filter":
        inner, change = _expression(node.args[0], filters), filters[node.args[1]]
        return lambda scope: change(inner(scope))
    args = [_expression(a, filters) for a in node.args]
    if node.kind == "choice":
        test, then, other = args
        return lambda scope: then(scope) if test(scope) else other(scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "==":
        left, right = args
        return lambda scope: left(scope) == right(scope)
    kind = node.kind
    return lambda scope: _value(kind, [a(scope) for a in args])


def _block(nodes: list, filters: dict[str, Callable]) -> Callable[[Scope], Iterator[str | Mark]]:
    """A closure that gives out the pieces of some nodes."""
    steps = [_node(n, filters) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: Scope) -> Iterator[str | Mark]:
        for step in steps:
            yield from step(scope)

    return run


def _node(node: Any, filters: dict[str, Callable]) -> Callable[[Scope], Iterator[str | Mark]]:
    if isinstance(node, Text):
        if isinstance(node.value, Const):
            pieces = (node.value.value,)
            return lambda scope: iter(pieces)
        value = _expression(node.value, filters)
        return lambda scope: iter((_shown(value(scope)),))
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value, filters)

        def put(scope: Scope) -> Iterator[str | Mark]:
            scope[name] = value(scope)
            return iter(())

        return put
    if isinstance(node, If):
        test, then, other = _expression(node.test, filters), _block(node.then, filters), _block(node.other, filters)
        return lambda scope: (then if test(scope) else other)(scope)
    if isinstance(node, Generation):
        inner = _block(node.body, filters)

        def marked(scope: Scope) -> Iterator[str | Mark]:
            yield OPEN
            yield from inner(scope)
            yield CLOSE

        return marked
    name, body = node.name, _block(node.body, filters)

    def loop(scope: Scope) -> Iterator[str | Mark]:
        rows = iter(scope["messages"])
        end = object()
        ahead, index = next(rows, end), 0
        while ahead is not end:
            message, ahead = ahead, next(rows, end)
            scope[name] = message
            scope["loop"] = {"first": index == 0, "last": ahead is end, "index0": index, "index": index + 1}
            yield from body(scope)
            yield TURN
            index += 1

    return loop


def _loops(nodes: list) -> int:
    return sum(1 if isinstance(n, For) else _loops(n.then) + _loops(n.other) if isinstance(n, If) else _loops(n.body) if isinstance(n, Generation) else 0 for n in nodes)


@dataclass
class Template:
    """A compiled template. ``pieces`` gives out texts and marks for a stream of messages ({role, text})."""

    source: str
    controls: Controls
    tree: list = field(repr=False)
    run: Callable[[Scope], Iterator[str | Mark]] = field(repr=False)

    def pieces(self, messages: Iterable[dict]) -> Iterator[str | Mark]:
        return self.run({"messages": messages})

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its generation spans, in code points."""
        text, spans, at = [], [], 0
        for piece in self.pieces(messages):
            if piece is OPEN:
                spans.append((at, at))
            elif piece is CLOSE:
                spans[-1] = (spans[-1][0], at)
            elif piece is not TURN:
                text.append(piece)
                at += len(piece)
        return "".join(text), spans


def compile_template(source: str, controls: Iterable[str]) -> Template:
    """Parse, fold and make closures; a template walks the messages once."""
    held = Controls(controls)
    filters = {**FILTERS, "escape": lambda v: held.escape(_shown(v))}
    tree = fold(parse(source), filters)
    if _loops(tree) > 1:
        raise TemplateError("the messages can be walked once")
    return Template(source, held, tree, _block(tree, filters))


#: The default template: instructions in brackets, the model's words up to the end sign, other roles by name.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
SOURCE = """
{%- for m in messages -%}
  {%- if loop.first -%} {{ '<s>' }} {%- endif -%}
  {%- if m.role == 'user' -%} {{ '[INST] ' ~ m.text | escape ~ ' [/INST]' }}
  {%- elif m.role == 'assistant' -%} {{ ' ' }} {%- generation -%} {{ m.text | escape }} {%- endgeneration -%} {{ '</s>' }}
  {%- else -%} {{ '[ROLE]' ~ m.role | escape ~ '[/ROLE]' ~ m.text | escape ~ '</s>' }}
  {%- endif -%}
{%- endfor -%}
"""


def default_template() -> Template:
    return compile_template(SOURCE, CONTROLS)


def read_turns(text: str, controls: Controls) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in a text, or part, that the default template made."""
    at = len("<s>") if text.startswith("<s>") else 0

    def until(sign: str, begin: int) -> tuple[str, int]:
        end = text.index(sign, begin)
        return controls.unescape(text[begin:end]), end + len(sign)

    while at < len(text):
        if text.startswith("[INST] ", at):
            body, at = until(" [/INST]", at + len("[INST] "))
            yield "user", body
        elif text.startswith("[ROLE]", at):
            role, at = until("[/ROLE]", at + len("[ROLE]"))
            body, at = until("</s>", at)
            yield role, body
        else:
            if text[at] != " ":
                raise ValueError(f"no turn begins at character {at}")
            body, at = until("</s>", at + 1)
            yield "assistant", body


# ---- Spark -------------------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.int32()))])


def format_conversations(conversations: DataFrame, source: str = SOURCE, controls: Iterable[str] = CONTROLS, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, spans): the conversations' texts in parts that end with a turn, in order.

    ``spans`` holds beginnings and ends of the generation spans in turn, in code points of the part. Rows of a
    conversation follow each other in one partition.
    """
    controls = tuple(controls)
    compile_template(source, controls)  # errors show here, not in a task

    def parts(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, rows in groupby(_rows(batches, "conv_id", "role", "text"), itemgetter(0)):
            text, spans, size, part = [], [], 0, 0
            for piece in template.pieces({"role": role, "text": body} for _, role, body in rows):
                if piece is TURN:
                    if size >= part_chars:
                        yield conv_id, part, "".join(text), spans
                        text, spans, size, part = [], [], 0, part + 1
                elif piece is OPEN or piece is CLOSE:
                    spans.append(size)
                else:
                    text.append(piece)
                    size += len(piece)
            if text or not part:
                yield conv_id, part, "".join(text), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(parts(compile_template(source, controls), batches), _PARTS, lambda row: len(row[2]))

    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn")]
    columns += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.mapInArrow(run, "conv_id bigint, part int, formatted string, spans array<int>")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("parts", pa.int64())])


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation of :func:`format_conversations` (default template), read back from its texts.

    Takes the parts as that function leaves them, so nothing is shuffled again.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        controls = Controls(CONTROLS)
        for conv_id, rows in groupby(_rows(batches, "conv_id", "formatted", "spans"), itemgetter(0)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = parts = 0
            for _, text, spans in rows:
                for role, body in read_turns(text, controls):
                    turns.update(f"{role}\n{body}\n".encode())
                    n_turns += 1
                for begin, end in zip(spans[::2], spans[1::2], strict=True):
                    learned = controls.unescape(text[begin:end])
                    loss.update(learned.encode())
                    loss_chars += len(learned)
                chars += len(text)
                parts += 1
            yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(digests(batches), _DIGEST, lambda row: 1)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, parts bigint")
