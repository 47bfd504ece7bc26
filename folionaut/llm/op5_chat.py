"""Chat formatting by a template compiler.

A template of a small sandboxed language is parsed into a syntax tree, constants are folded, and the tree is
turned into Python closures, once per task. The language has text, `{{ expression }}`, `{% for x in list %}`,
`{% if %}/{% elif %}/{% else %}`, `{% set x = ... %}` and `{% generation %}` blocks, whose output is marked for the loss.
Expressions are literals, names, fields (`m.role`; only of mappings), `loop.index`, `loop.first`, `loop.last`, `==`, `!=`, `+`, `and`, `or`,
`not`, brackets and the filters `escape`, `trim`, `upper`, `lower`, `length`. Nothing else can be reached: no
attributes, calls or imports.

Control strings inside texts are escaped by a backslash after their first character; a control string that
already has backslashes there gets one more, so taking one away again gives back any text.

A conversation's turns are brought together by sorting, and one conversation at a time is rendered; its text is held whole, however long. Null texts
and roles count as empty; turns that tie are ordered by role, then text, and nulls come first; a null conv_id is a
conversation of its own. Repeated rows are turns like any other. Empty tables give only what was added, and a conversation
-1 in the table stays apart from the one that is added. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, slices, table

#: What the template marks turns with, and others' control strings that a text must not smuggle in.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + BODY
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    + "{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)
ADDED = "</s>[INST] ok [/INST]"

_inside = "|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in CONTROLS)
_ESCAPE, _UNESCAPE = re.compile(_inside), re.compile(_inside.replace(r"(\\*)", r"(\\+)"))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


class TemplateError(ValueError):
    """A template that the language doesn't have, or a value that it can't use."""


# --- expressions: a tree of tuples ---------------------------------------------------------------------------
_TOKEN = re.compile(r"\s*(?:('[^']*'|\"[^\"]*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+().|]))")
_FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class _Expression:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"too much: {self.tokens[self.at][1]!r}")

    def take(self, *words: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] > 2 and self.tokens[self.at][1] in words:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, below: Callable, *words: str) -> tuple:
        tree = below()
        while op := self.take(*words):
            tree = fold((op, tree, below()))
        return tree

    def either(self) -> tuple:
        return self.chain(self.both, "or")

    def both(self) -> tuple:
        return self.chain(self.negated, "and")

    def negated(self) -> tuple:
        return fold(("not", self.negated())) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        return self.chain(self.added, "==", "!=")

    def added(self) -> tuple:
        return self.chain(self.filtered, "+")

    def filtered(self) -> tuple:
        tree = self.single()
        while self.take("|"):
            tree = fold(("filter", self.name(_FILTERS), tree))
        return tree

    def name(self, known=None) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3 or known and self.tokens[self.at][1] not in known:
            raise TemplateError("a name is missing or unknown")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def single(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, word = self.tokens[self.at]
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return tree
        self.at += 1
        if kind == 1:
            return ("const", word[1:-1])
        if kind == 2:
            return ("const", int(word))
        if kind != 3 or word.startswith("_"):
            raise TemplateError(f"unexpected {word!r}")
        tree = ("const", word == "true") if word in ("true", "false") else ("name", word)
        while self.take("."):
            tree = ("field", tree, self.name())
        return tree


def fold(tree: tuple) -> tuple:
    """The tree, or its value if all of its parts are constants."""
    parts = [x for x in tree[1:] if isinstance(x, tuple)]
    return ("const", closure(tree)({})) if all(x[0] == "const" for x in parts) else tree


def closure(tree: tuple) -> Callable[[dict], object]:
    """A function from the names' values to the expression's value."""
    kind = tree[0]
    if kind == "const":
        return lambda env, value=tree[1]: value
    if kind == "name":
        return lambda env, name=tree[1]: env[name] if name in env else _missing(name)
    if kind == "field":
        inner, name = closure(tree[1]), tree[2]

        def field(env):
            of = inner(env)
            return of[name] if isinstance(of, dict) and name in of else _missing(name)

        return field
    if kind == "filter":
        inner, call = closure(tree[2]), _FILTERS[tree[1]]
        return lambda env: call(inner(env)) if tree[1] == "length" else call(_text(inner(env)))
    if kind == "not":
        inner = closure(tree[1])
        return lambda env: not inner(env)
    a, b = closure(tree[1]), closure(tree[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "==":
        return lambda env: a(env) == b(env)
    if kind == "!=":
        return lambda env: a(env) != b(env)

    def plus(env):
        x, y = a(env), b(env)
        return x + y if isinstance(x, int) and isinstance(y, int) else _text(x) + _text(y)

    return plus


def _missing(name: str):
    raise TemplateError(f"there is no {name!r}")


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# --- statements ----------------------------------------------------------------------------------------------
Emit = Callable[[str, bool], None]  # takes a piece and whether the loss counts it


def parse(template: str) -> list[tuple]:
    """The syntax tree: text, out, for, if, set and generation nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    tags = [("text", x) if i % 2 == 0 else ("out", x[2:-2]) if x[1] == "{" else ("tag", x[2:-2].strip()) for i, x in enumerate(parts) if x]
    at = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(tags):
            kind, body = tags[at]
            at += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "out":
                tree = _Expression(body).tree
                nodes.append(("text", _text(tree[1])) if tree[0] == "const" else ("out", tree))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, body
                if word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                    nodes.append(("for", m[1], _Expression(m[2]).tree, block("endfor")[0]))
                elif word == "if":
                    cases, test = [], rest
                    while True:
                        own, end = block("elif", "else", "endif")
                        cases.append((_Expression(test).tree, own))
                        if end.startswith("elif"):
                            test = end[4:]
                            continue
                        cases.append((("const", True), block("endif")[0] if end == "else" else []))
                        break
                    live = []
                    for test_tree, own in cases:  # branches that constants decide go now
                        if test_tree[0] == "const" and not test_tree[1]:
                            continue
                        live.append((test_tree, own))
                        if test_tree[0] == "const":
                            break
                    nodes += live[0][1] if live[0][0][0] == "const" else [("if", live)]
                elif word == "set" and (m := re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest, re.S)):
                    nodes.append(("set", m[1], _Expression(m[2]).tree))
                elif word == "generation":
                    nodes.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return _joined(block()[0])


def _joined(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring texts become one."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node[0] == "for":
            out.append((*node[:3], _joined(node[3])))
        elif node[0] == "generation":
            out.append(("generation", _joined(node[1])))
        elif node[0] == "if":
            out.append(("if", [(test, _joined(own)) for test, own in node[1]]))
        else:
            out.append(node)
    return out


def _run(nodes: list[tuple]) -> Callable[[dict, Emit, bool], None]:
    steps = [_step(node) for node in nodes]

    def run(env: dict, emit: Emit, loss: bool) -> None:
        for step in steps:
            step(env, emit, loss)

    return run


def _step(node: tuple) -> Callable[[dict, Emit, bool], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, emit, loss, text=node[1]: emit(text, loss)
    if kind == "out":
        value = closure(node[1])
        return lambda env, emit, loss: emit(_text(value(env)), loss)
    if kind == "set":
        name, value = node[1], closure(node[2])
        return lambda env, emit, loss: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = _run(node[1])
        return lambda env, emit, loss: inner(env, emit, True)
    if kind == "if":
        cases = [(closure(test), _run(own)) for test, own in node[1]]

        def choose(env, emit, loss):
            for test, own in cases:
                if test(env):
                    return own(env, emit, loss)
            return None

        return choose
    name, values, inner = node[1], closure(node[2]), _run(node[3])

    def each(env, emit, loss):
        items = values(env)
        if not isinstance(items, list):
            raise TemplateError("for needs a list")
        for i, item in enumerate(items):
            inner(env | {name: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, emit, loss)

    return each


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to (text, spans of the text that the loss counts)."""
    run = _run(parse(template))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, loss: bool) -> None:
            nonlocal at
            if loss and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            pieces.append(text)
            at += len(text)

        run({"messages": messages}, emit, False)
        return "".join(pieces), spans

    return render


_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of what TEMPLATE rendered."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


# --- on tables -----------------------------------------------------------------------------------------------
def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (array of start, end in code points of what the loss counts)."""

    def render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def rows():
            for batch in (part for whole in batches for part in slices(whole, rows=10_000)):
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        out, held = [], 0
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            formatted, spans = render([{"role": r, "text": t} for _, r, t in own])
            out.append((conv, formatted, spans))
            held += len(formatted)
            if held > 4_000_000:
                yield _batch(out, CHATS)
                out, held = [], 0
        if out:
            yield _batch(out, CHATS)

    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = plain.withColumn("conv_id", F.col("conv_id").cast("long"))
    ordered = plain.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(render_all, "conv_id long, formatted string, spans array<array<long>>")


CHATS = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
            turns = read_back(formatted)
            # Each span lies in one turn's text, so it is unescaped by itself.
            loss = "".join(unescape(formatted[a:b]) for a, b in spans)
            said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        yield _batch(out, DIGESTS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = [(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(added, "conv_id long, turn long, role string, text string")
    formatted = format_chats(turns).unionByName(format_chats(more.coalesce(1)))
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_groups = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
_marks = len(TURN) + len(BODY) + len(END)
ORACLE = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, x, r, '{ADDED}' from (values (0, 'user'), (1, 'assistant')) v(x, r))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       sum({_marks} + length(role) + length(text) + len(regexp_extract_all(role, '{_groups}')) + len(regexp_extract_all(text, '{_groups}')))::bigint as formatted_chars
from t group by conv_id
"""
