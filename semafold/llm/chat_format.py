"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested Python closures that
yield (text, is_generation) pieces. The language is sandboxed: names come from the given context alone, attributes are
dictionary keys, filters come from a fixed table, and there are no calls.

    {{ expr }}    {% if e %} {% elif e %} {% else %} {% endif %}    {% for x in e %} {% endfor %}
    {% generation %} {% endgeneration %}                           marks text that the model is to learn
    expressions: 'text', 12, true, false, none, name, a.b, a['b'], not, and, or, ==, !=, +, e | filter, ( )
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts cannot hold "<", "[" or "\\" once escaped, so no control string can be part of one.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_UNESCAPES = {"\\": "\\", "l": "<", "b": "["}
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _UNESCAPES[m[1]], text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
#: Turns are <s>[ROLE]role[/ROLE] ... </s>; what the assistant says is under the loss mask.
CHAT = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>\n{% endfor %}"
)
_TURN = re.compile(r"<s>\[ROLE\]([^<\[]*)\[/ROLE\]\n([^<\[]*)</s>\n")
_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*)|(==|!=|[|().\[\]+]))")
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; nodes are tuples whose first item is the kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKENS.match(source, at)):
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if texts and not self.peek(*texts) or self.at >= len(self.tokens):
            raise TemplateError(f"expected {' or '.join(texts) or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _left(self, below: Callable, *operators: str) -> tuple:
        node = below()
        while self.peek(*operators):
            node = (self.take(), node, below())
        return node

    def either(self) -> tuple:
        return self._left(self.both, "or")

    def both(self) -> tuple:
        return self._left(self.negated, "and")

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self._left(self.total, "==", "!=")

    def total(self) -> tuple:
        return self._left(self.filtered, "+")

    def filtered(self) -> tuple:
        node = self.value()
        while self.peek("|"):
            self.take()
            if (name := self.take()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def value(self) -> tuple:
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else 0
        text = self.take()
        if kind == 1:
            node = ("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif kind == 2:
            node = ("constant", int(text))
        elif kind == 3:
            node = ("constant", _CONSTANTS[text]) if text in _CONSTANTS else ("name", text)
        elif text == "(":
            node = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek(".", "["):
            if self.take() == ".":
                node = ("item", node, ("constant", self.take()))
            else:
                node = ("item", node, self.either())
                self.take("]")
        return node


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("show", e), ("if", [(e, body)...], else body), ("for", name, e, body), ("generation", body)."""
    parts, at = [p for p in _PARTS.split(source) if p], 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                out.append(("show", _Expression(part[2:-2]).parse()))
            elif part.startswith("{%") and part.endswith("%}"):
                inner = part[2:-2].strip()
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return out, inner
                if word == "if":
                    cases, otherwise, said = [], [], inner
                    while said.partition(" ")[0] in ("if", "elif"):
                        test = _Expression(said.partition(" ")[2]).parse()
                        inside, said = body("elif", "else", "endif")
                        cases.append((test, inside))
                    if said == "else":
                        otherwise, _ = body("endif")
                    out.append(("if", cases, otherwise))
                elif word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                    inside, _ = body("endfor")
                    out.append(("for", m[1], _Expression(m[2]).parse(), inside))
                elif word == "generation":
                    inside, _ = body("endgeneration")
                    out.append(("generation", inside))
                else:
                    raise TemplateError(f"unexpected {part!r}")
            else:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body()[0]


def _fold_expression(node: tuple) -> tuple:
    if node[0] in ("constant", "name"):
        return node
    folded = tuple(_fold_expression(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "constant" for x in folded if isinstance(x, tuple)):
        return ("constant", _expression(folded)({}))
    return folded


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant expressions become values, settled branches go, neighbouring texts join."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "show":
            value = _fold_expression(node[1])
            node = ("text", _shown(value[1])) if value[0] == "constant" else ("show", value)
        elif kind == "if":
            cases, otherwise = [], fold(node[2])
            for test, inside in node[1]:
                test = _fold_expression(test)
                if test[0] != "constant":
                    cases.append((test, fold(inside)))
                elif test[1]:
                    otherwise = fold(inside)
                    break
            node = ("if", cases, otherwise) if cases else ("all", otherwise)
        elif kind == "for":
            node = ("for", node[1], _fold_expression(node[2]), fold(node[3]))
        elif kind == "generation":
            node = ("generation", fold(node[1]))
        for part in node[1] if node[0] == "all" else [node]:
            if part[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + part[1])
            elif part != ("text", ""):
                out.append(part)
    return out


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "constant":
        return lambda _, v=node[1]: v
    if kind == "name":
        return lambda scope, k=node[1]: scope.get(k)
    if kind == "filter":
        of, inner = FILTERS[node[1]], _expression(node[2])
        return lambda scope: of(_shown(inner(scope)))
    if kind == "not":
        inner = _expression(node[1])
        return lambda scope: not inner(scope)
    left, right = _expression(node[1]), _expression(node[2])
    if kind == "item":
        return lambda scope: held.get(right(scope)) if isinstance(held := left(scope), dict) else None
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    if kind == "==":
        return lambda scope: left(scope) == right(scope)
    if kind == "!=":
        return lambda scope: left(scope) != right(scope)
    return lambda scope: _shown(left(scope)) + _shown(right(scope))


Pieces = Iterator[tuple[str, bool]]


def _body(nodes: list[tuple]) -> Callable[[dict, bool], Pieces]:
    steps = [_node(n) for n in nodes]

    def render(scope: dict, learn: bool) -> Pieces:
        for step in steps:
            yield from step(scope, learn)

    return render


def _node(node: tuple) -> Callable[[dict, bool], Pieces]:
    kind = node[0]
    if kind == "text":
        return lambda _, learn, text=node[1]: iter([(text, learn)])
    if kind == "show":
        value = _expression(node[1])
        return lambda scope, learn: iter([(_shown(value(scope)), learn)])
    if kind == "generation":
        inside = _body(node[1])
        return lambda scope, _: inside(scope, True)
    if kind == "if":
        cases, otherwise = [(_expression(t), _body(b)) for t, b in node[1]], _body(node[2])
        return lambda scope, learn: next((b for t, b in cases if t(scope)), otherwise)(scope, learn)
    name, items, inside = node[1], _expression(node[2]), _body(node[3])

    def loop(scope: dict, learn: bool) -> Pieces:
        for item in items(scope) or ():
            yield from inside(scope | {name: item}, learn)

    return loop


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A function of a context that yields (text, is_generation) pieces; lists in the context may be iterators."""
    render = _body(fold(parse(source)))
    return lambda context: render(context, False)


def render(template: Callable[[dict], Pieces], messages: list[dict]) -> tuple[str, list[list[int]]]:
    """The formatted text, and the [start, end) code points of it that are under the loss mask, a span for each piece."""
    out, spans, at = [], [], 0
    for text, learn in template({"messages": messages}):
        out.append(text)
        if learn and text:
            spans.append([at, at + len(text)])
        at += len(text)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that CHAT made."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<array<long>>"


def format_conversations(rows: DataFrame, template: str = CHAT) -> DataFrame:
    """A row per conv_id: n_turns, the formatted text and its loss spans.

    Rows are taken by turn; null turns come first, ties go by role, then text; repeated rows are turns of their own. Null
    texts and roles count as empty. Rows with a null conv_id are one conversation. Other columns are not read; an empty
    table gives an empty result. A conversation is one output cell, so its own text must fit a task; rows stream past
    in order, and a task holds one conversation at a time.
    """
    compile_template(template)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = compile_template(template)
        key, turns, out = None, [], []

        def close() -> None:
            if turns:
                text, spans = render(ready, turns)
                out.append((key, len(turns), text, spans))

        for frame in frames:
            for conv, null, role, text in zip(frame["c"], frame["null"], frame["role"], frame["text"], strict=True):
                now = None if null else conv
                if turns and now != key:
                    close()
                    turns = []
                key = now
                turns.append({"role": role, "text": text})
            if len(out) >= 500:
                yield _frame(out)
                out = []
        close()
        yield _frame(out)

    def _frame(out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "loss_spans"])
        return frame.astype({"conv_id": "Int64", "n_turns": "int64"})

    empty = F.lit("")
    turns = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("null"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"),
    )
    ordered = turns.repartition("c", "null").sortWithinPartitions("c", "null", "turn", "role", "text")
    return ordered.mapInPandas(run, FORMATTED)


def read_back_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text itself says: its turns, and the unescaped text under the loss mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, spans in zip(frame["formatted"], frame["loss_spans"], strict=True):
                turns = read_back(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                out.append((len(turns), _sha(told), len(loss), _sha(loss), len(text)))
            done = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.insert(0, "conv_id", frame["conv_id"].astype("Int64").to_numpy())
            yield done

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back_digests(format_conversations(rows.unionByName(planted)))
