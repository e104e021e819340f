"""Conversations as training text: a small sandboxed template language, compiled to closures that also mark what is learned."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Strings with a meaning in the formatted text; inside a turn they are broken by a backslash after their first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]")
#: How turns are marked: the opening string, the role it stands for and the closing string. Other roles are written out.
MARKS = {"[INST]": ("user", "[/INST]"), "<s>": ("assistant", "</s>")}
TEMPLATE = """
{%- for turn in turns -%}
  {%- if turn.role == 'user' -%}[INST]{{ turn.text | guard }}[/INST]
  {%- elif turn.role == 'assistant' -%}<s>{% generation %}{{ turn.text | guard }}{% endgeneration %}</s>
  {%- else -%}[ROLE]{{ turn.role | guard }}[/ROLE]{{ turn.text | guard }}[/TURN]
  {%- endif -%}
{%- endfor -%}
"""


class TemplateError(ValueError):
    """A template that is malformed or steps outside the sandbox."""


# ---- control strings ----------------------------------------------------------------------

@dataclass(frozen=True)
class Guard:
    """Reversible escapes: a control string c + rest, with any backslashes between, gets one more backslash.

    Such runs cannot overlap, as no rest holds a first character, so taking one backslash out of each run undoes it, and a
    guarded text holds no control string, also not together with what stands around it.
    """

    controls: tuple[str, ...]

    def __post_init__(self):
        firsts = {c[:1] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or "\\" in c or firsts & set(c[1:]):
                raise TemplateError(f"unfit control string {c!r}")

    def _runs(self, backslashes: str) -> str:
        return "|".join(re.escape(c[0]) + backslashes + re.escape(c[1:]) for c in self.controls) or "(?!)"

    @cached_property
    def plain(self) -> re.Pattern:
        return re.compile(self._runs(r"\\*"))

    @cached_property
    def guarded(self) -> re.Pattern:
        return re.compile(self._runs(r"\\+"))

    @cached_property
    def bare(self) -> re.Pattern:
        return re.compile(f"({self._runs('')})")

    def __call__(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def undo(self, text: str) -> str:
        return self.guarded.sub(lambda m: m[0][0] + m[0][2:], text)

    def split(self, text: str) -> list[str]:
        """Plain and control strings in turn, a plain one first and last."""
        return self.bare.split(text)


# ---- syntax tree --------------------------------------------------------------------------

@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'[^'\\]*'|\"[^\"\\]*\")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[.|~()]))")
#: What a record of the loop and the loop itself offer, and what a value can be passed through.
FIELDS = {"turn": ("role", "text"), "loop": ("first", "last", "index")}
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}
WORDS = ("and", "or", "not", "in", "true", "false")


class _Expression:
    """Recursive descent over one expression: or, and, not, ==, !=, ~, filters, fields of a name."""

    def __init__(self, source: str, names: dict[str, str], filters: dict):
        self.tokens, self.names, self.filters, at = [], names, filters, 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if found is None:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def read(self) -> Node:
        node = self._joined("or", lambda: self._joined("and", self._negated))
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _joined(self, word: str, inner) -> Node:
        parts = [inner()]
        while self._take(word):
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Node(word, None, parts)

    def _negated(self) -> Node:
        if self._take("not"):
            return Node("not", None, [self._negated()])
        left = self._joined("~", self._filtered)
        sign = self._take("==", "!=")
        return Node(sign, None, [left, self._joined("~", self._filtered)]) if sign else left

    def _filtered(self) -> Node:
        node = self._atom()
        while self._take("|"):
            kind, name = self._next()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            node = Node("filter", name, [node])
        return node

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def _atom(self) -> Node:
        kind, value = self._next()
        if kind == "text":
            return Node("const", value[1:-1])
        if kind == "int":
            return Node("const", int(value))
        if value == "(":
            inner = self._joined("or", lambda: self._joined("and", self._negated))
            if not self._take(")"):
                raise TemplateError("missing )")
            return inner
        if value in ("true", "false"):
            return Node("const", value == "true")
        if kind != "name" or value in WORDS or value not in self.names:
            raise TemplateError(f"unknown name {value!r}")
        if self.names[value] == "value":
            return Node("name", value)
        if not self._take("."):
            raise TemplateError(f"{value!r} is no value")
        kind, name = self._next()
        if kind != "name" or name not in FIELDS[self.names[value]]:
            raise TemplateError(f"{value}.{name} is out of reach")
        return Node("field", (value, name))


def parse(source: str, values: Sequence[str] = (), filters: dict | None = None) -> Node:
    """The syntax tree of a template. Names are the stated values, `turns` in a loop, and the loop's own; nothing else is in reach.

    There are no calls, no attributes beyond FIELDS and no loop within a loop, so a rendering ends and is linear in
    the turns.
    """
    names = dict.fromkeys(values, "value")
    known = {**FILTERS, "guard": str, **(filters or {})}
    pieces, at = [], 0
    for tag in _TAG.finditer(source):
        text = source[at : tag.start()]
        pieces.append(("text", text.rstrip() if tag[0][2] == "-" else text))
        pieces.append(("do", tag[1]) if tag[1] is not None else ("out", tag[2]) if tag[2] is not None else ("text", ""))
        at = tag.end()
        if tag[0][-3] == "-":
            at += len(source) - at - len(source[at:].lstrip())
    pieces.append(("text", source[at:]))
    pieces.reverse()

    def expression(text: str) -> Node:
        return _Expression(text, names, known).read()

    def block(ends: tuple[str, ...], inside: tuple[str, ...] = ()) -> tuple[Node, str]:
        body = Node("block")
        while pieces:
            kind, text = pieces.pop()
            if kind == "text":
                body.parts.append(Node("text", text))
                continue
            if kind == "out":
                body.parts.append(Node("out", None, [expression(text)]))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return body, text
            body.parts.append(statement(word, rest.strip(), inside))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    def statement(word: str, rest: str, inside: tuple[str, ...]) -> Node:
        if word == "for":
            loop = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+turns", rest)
            if loop is None or "for" in inside or loop[1] in (*names, *WORDS, "loop", "turns"):
                raise TemplateError(f"no loop can be made of {rest!r}")
            names.update({loop[1]: "turn", "loop": "loop"})
            body, _ = block(("endfor",), (*inside, "for"))
            del names[loop[1]], names["loop"]
            return Node("for", loop[1], [body])
        if word == "generation" and not rest and "generation" not in inside:
            return Node("generation", None, [block(("endgeneration",), (*inside, "generation"))[0]])
        if word == "if":
            node, test = Node("if"), expression(rest)
            while True:
                body, end = block(("elif", "else", "endif"), inside)
                node.parts.append((test, body))
                if end == "endif":
                    return node
                if test is None:
                    raise TemplateError(f"{end} after else")
                test = None if end == "else" else expression(end[4:])
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


def fold(node: Node, filters: dict) -> Node:
    """The tree with constant expressions worked out, settled branches chosen and neighbouring texts joined."""
    if node.kind == "if":
        kept = []
        for test, body in node.parts:
            test, body = (None if test is None else fold(test, filters)), fold(body, filters)
            if test is not None and test.kind == "const" and not test.value:
                continue
            always = test is None or test.kind == "const"
            kept.append((None if always else test, body))
            if always:
                break
        if not kept:
            return Node("block")
        return kept[0][1] if kept[0][0] is None else Node("if", None, kept)
    node = Node(node.kind, node.value, [fold(p, filters) for p in node.parts])
    if node.kind == "block":
        flat: list[Node] = []
        for part in node.parts:
            for p in part.parts if part.kind == "block" else [part]:
                if p.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + p.value)
                elif p.kind != "text" or p.value:
                    flat.append(p)
        return Node("block", None, flat)
    if node.parts and all(p.kind == "const" for p in node.parts):
        if node.kind == "out":
            return Node("text", _shown(node.parts[0].value))
        if node.kind in ("or", "and", "not", "==", "!=", "~", "filter"):
            return Node("const", _expression(node, {}, filters)(()))
    return node


# ---- closures -----------------------------------------------------------------------------

def _shown(value) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _expression(node: Node, slots: dict[str, int], filters: dict) -> Callable:
    parts = [_expression(p, slots, filters) for p in node.parts]
    if node.kind == "const":
        value = node.value
        return lambda env: value
    if node.kind == "name":
        slot = slots[node.value]
        return lambda env: env[slot]
    if node.kind == "field":
        slot, name = slots[node.value[0]], node.value[1]
        return lambda env: env[slot][name]
    if node.kind == "filter":
        inner, through = parts[0], filters[node.value]
        return lambda env: through(_shown(inner(env)))
    if node.kind == "not":
        return lambda env: not parts[0](env)
    if node.kind in ("==", "!="):
        same = node.kind == "=="
        return lambda env: (parts[0](env) == parts[1](env)) == same
    if node.kind == "~":
        return lambda env: "".join(_shown(p(env)) for p in parts)
    pick = any if node.kind == "or" else all
    return lambda env: pick(p(env) for p in parts)


class Rendering:
    """Text written so far, its length in code points, and the stretches under the loss mask."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.learned: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _writer(node: Node, slots: dict[str, int], filters: dict) -> Callable:
    if node.kind == "text":
        text = node.value
        return lambda env, to: to.write(text)
    if node.kind == "out":
        value = _expression(node.parts[0], slots, filters)
        return lambda env, to: to.write(_shown(value(env)))
    if node.kind == "block":
        steps = [_writer(p, slots, filters) for p in node.parts]

        def block(env, to):
            for step in steps:
                step(env, to)

        return block
    if node.kind == "if":
        cases = [(None if t is None else _expression(t, slots, filters), _writer(b, slots, filters)) for t, b in node.parts]

        def choose(env, to):
            for test, body in cases:
                if test is None or test(env):
                    return body(env, to)

        return choose
    if node.kind == "generation":
        body = _writer(node.parts[0], slots, filters)

        def generation(env, to):
            start = to.size
            body(env, to)
            to.learned.append((start, to.size))

        return generation
    inner = {**slots, node.value: len(slots), "loop": len(slots) + 1}
    body = _writer(node.parts[0], inner, filters)

    def loop(env, to):
        turns = env[0]
        for i, turn in enumerate(turns):
            body((*env, turn, {"index": i, "first": i == 0, "last": i == len(turns) - 1}), to)

    return loop


def _check_marks(node: Node, guard: Guard) -> None:
    """Every text of the template is made of control strings and characters that none begins with; all else is guarded."""
    if node.kind == "text":
        firsts = {c[0] for c in guard.controls}
        if any(firsts & set(plain) or "\\" in plain for plain in guard.split(node.value)[::2]):
            raise TemplateError(f"{node.value!r} could be taken for a control string")
    elif node.kind == "out":
        if guard.controls and not (node.parts[0].kind == "filter" and node.parts[0].value == "guard"):
            raise TemplateError("a value must end in | guard")
    elif node.kind == "if":
        for _, body in node.parts:
            _check_marks(body, guard)
    elif node.kind in ("block", "for", "generation"):
        for part in node.parts:
            _check_marks(part, guard)


def compile_template(source: str = TEMPLATE, controls: Sequence[str] = CONTROLS, values: Sequence[str] = ()) -> Callable[..., Rendering]:
    """A function from turns (dicts of role and text) and the stated values to a rendering."""
    guard = Guard(tuple(controls))
    filters = {**FILTERS, "guard": guard}
    tree = fold(parse(source, values, filters), filters)
    _check_marks(tree, guard)
    slots = {name: i for i, name in enumerate(("turns", *values))}
    write = _writer(tree, slots, filters)

    def render(turns: Sequence[dict], **given) -> Rendering:
        to = Rendering()
        write((turns, *[given[v] for v in values]), to)
        return to

    return render


# ---- reading back -------------------------------------------------------------------------

def read_turns(formatted: str, controls: Sequence[str] = CONTROLS) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text that TEMPLATE made, unguarded."""
    guard = Guard(tuple(controls))
    pieces, turns, at = guard.split(formatted), [], 1
    while at < len(pieces):
        opened = pieces[at]
        if opened in MARKS:
            role, close, text = MARKS[opened][0], MARKS[opened][1], pieces[at + 1]
            ends = pieces[at + 2 : at + 3]
            at += 4
        else:
            role, close, text = guard.undo(pieces[at + 1]), "[/TURN]", pieces[at + 3]
            ends = pieces[at + 4 : at + 5]
            at += 6
        if ends != [close]:
            raise ValueError(f"no {close} after {opened}")
        turns.append((role, guard.undo(text)))
    return turns


# ---- on Spark -----------------------------------------------------------------------------

FORMATTED = "conv_id long, formatted string, learned array<struct<start: int, end: int>>"
_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()), ("learned", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
#: Characters of finished conversations a task gathers before it hands them on.
HANDED_CHARS = 4_000_000


def _format(template: str, controls: Sequence[str]):
    def format_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        now, turns, done, size = None, [], [], 0

        def finish() -> int:
            made = render(turns)
            done.append((now, "".join(made.parts), [{"start": a, "end": b} for a, b in made.learned]))
            return made.size

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _FORMATTED)], schema=_FORMATTED)

        for batch in slices(batches):
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    if now is not None:
                        size += finish()
                    now, turns = conv, []
                    if size > HANDED_CHARS:
                        yield handed()
                        done, size = [], 0
                turns.append({"role": role or "", "text": text or ""})
        if now is not None:
            finish()
        if done:
            yield handed()

    return format_


def formatted_chats(rows: DataFrame, template: str = TEMPLATE, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """conv_id, formatted and learned (stretches under the loss mask, in code points) of every conversation.

    Turns are ordered by number, null first; equal numbers by role and text. Null roles and texts are empty. Rows without a
    conversation id belong to no conversation and are left out; repeated rows are turns of their own. Rows are dealt by
    conversation and sorted, and a task holds one conversation beside what it has finished. An empty table gives an empty
    table; other columns are not read.
    """
    compile_template(template, controls)  # a faulty template fails here and not in a task
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return sorted_.mapInArrow(_format(template, controls), FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    guard = Guard(CONTROLS)
    for batch in slices(batches):
        out = []
        for conv, formatted, learned in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "learned"))):
            turns, whole, loss, chars = read_turns(formatted), hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            for stretch in learned:
                text = guard.undo(formatted[stretch["start"] : stretch["end"]])
                loss.update(text.encode())
                chars += len(text)
            out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        if out:
            names = [c.split(" ")[0] for c in READ.split(", ")]
            types = [pa.string() if c.endswith("string") else pa.int64() for c in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What can be read from texts of `formatted_chats`: turns, their digest, the learned text's length and digest, all lengths in code points."""
    return formatted.select("conv_id", "formatted", "learned").mapInArrow(_read, READ)
