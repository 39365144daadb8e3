"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded,
and the tree becomes nested Python closures that write the text and note which parts the
model generated.

Language: ``{{ expression }}``, ``{% if e %} {% elif e %} {% else %} {% endif %}``,
``{% for x in e %} {% endfor %}`` (with ``loop.index``, ``loop.first``, ``loop.last``)
and ``{% generation %} {% endgeneration %}``.  Expressions have string and integer
literals, names, ``a.b`` and ``a['b']`` (dictionary keys only), ``+``, ``==``, ``!=``,
``not``, ``and``, ``or``, parentheses and ``| filter``.  Nothing else can be reached:
there are no calls, no Python attributes and only the filters of FILTERS.

Defined cases: a null text or role counts as empty; turns are ordered by turn, then role,
then text (null turns first), so ties and repeated rows have one order and all are kept;
a conversation is a group of equal conv_id, null being one group; an empty table gives an
empty result; texts are never cut; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for m in messages %}{{ '<|im_' + 'start|>' }}{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_' + 'end|>' }}\n{% endfor %}"
)


def escape(text: str) -> str:
    """No ``<|`` is left: one backslash goes between ``<`` and ``|`` and any backslashes there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "lower": str.lower, "upper": str.upper}

Node = tuple  # (kind, ...)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()\[\]]))")


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent; gives a tree of ('const', v), ('name', n), ('get', e, key), ..."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.items[self.at] if self.at < len(self.items) else (None, None)
        return None if kind in ("str", "int") else value

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def whole(self) -> Node:
        tree = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def either(self) -> Node:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> Node:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        tree = self.added()
        while op := self.take("==", "!="):
            tree = (op, tree, self.added())
        return tree

    def added(self) -> Node:
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> Node:
        tree = self.postfix()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", tree, name)
        return tree

    def name(self) -> str:
        kind, value = self.items[self.at] if self.at < len(self.items) else (None, "end")
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"name expected, not {value!r}")
        self.at += 1
        return value

    def postfix(self) -> Node:
        tree = self.primary()
        while op := self.take(".", "["):
            if op == ".":
                tree = ("get", tree, ("const", self.name()))
            else:
                tree = ("get", tree, self.either())
                self.need("]")
        return tree

    def primary(self) -> Node:
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        kind, value = self.items[self.at] if self.at < len(self.items) else (None, "end")
        if kind == "str":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            self.at += 1
            return ("const", int(value))
        if value in ("true", "false"):
            self.at += 1
            return ("const", value == "true")
        return ("name", self.name())


def parse(template: str) -> list[Node]:
    """The template's syntax tree: text, out, if, for and generation nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[list[Node], str]:
        nonlocal at
        out: list[Node] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(("out", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, f"{word} {rest}"
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    body, _ = block("endfor")
                    out.append(("for", m[1], _Expression(m[2]).whole(), body))
                elif word == "if":
                    arms, test, end = [], _Expression(rest).whole(), ""
                    while not end.startswith("endif"):
                        body, end = block("elif", "else", "endif")
                        arms.append((test, body))
                        test = _Expression(end[5:]).whole() if end.startswith("elif") else ("const", True)
                    out.append(("if", arms))
                elif word == "generation":
                    body, _ = block("endgeneration")
                    out.append(("generation", body))
                else:
                    raise TemplateError(f"unknown or unmatched tag {word!r}")
            elif part:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return block()[0]


_APPLY: dict[str, Callable] = {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def fold(node: Node) -> Node:
    """The expression with everything computed that depends on no name."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(node[1])
        return ("const", FILTERS[node[2]](inner[1])) if inner[0] == "const" else ("filter", inner, node[2])
    args = [fold(x) for x in node[1:]]
    if kind in ("and", "or"):
        if args[0][0] == "const":
            return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    elif all(a[0] == "const" for a in args):
        if kind in _APPLY:
            return ("const", _APPLY[kind](args[0][1], args[1][1]))
        if kind == "not":
            return ("const", not args[0][1])
    return (kind, *args)


def fold_block(nodes: list[Node]) -> list[Node]:
    """Folded expressions, decided ifs, and neighbouring texts as one."""
    out: list[Node] = []
    for node in nodes:
        kind, new = node[0], [node]
        if kind == "out":
            e = fold(node[1])
            new = [("text", str(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "for":
            new = [("for", node[1], fold(node[2]), fold_block(node[3]))]
        elif kind == "generation":
            new = [("generation", fold_block(node[1]))]
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_block(body)))
                if test[0] == "const":
                    break
            new = (arms[0][1] if arms[0][0][0] == "const" else [("if", arms)]) if arms else []
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


class _Writer:
    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Node) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        v = node[1]
        return lambda scope: v
    if kind == "name":
        n = node[1]
        return lambda scope: scope.get(n)
    a = _value(node[1])
    if kind == "filter":
        f = FILTERS[node[2]]
        return lambda scope: f("" if (x := a(scope)) is None else str(x))
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(node[2])
    if kind == "get":
        return lambda scope: x.get(b(scope)) if isinstance(x := a(scope), dict) else None
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    f2 = _APPLY[kind]
    return lambda scope: f2(a(scope), b(scope))


def _body(nodes: list[Node]) -> Callable[[dict, _Writer], None]:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, to: _Writer) -> None:
        for s in steps:
            s(scope, to)

    return run


def _step(node: Node) -> Callable[[dict, _Writer], None]:
    kind = node[0]
    if kind == "text":
        t = node[1]
        return lambda scope, to: to.write(t)
    if kind == "out":
        v = _value(node[1])
        return lambda scope, to: to.write("" if (x := v(scope)) is None else str(x))
    if kind == "generation":
        inside = _body(node[1])

        def generation(scope: dict, to: _Writer) -> None:
            at = to.length
            inside(scope, to)
            to.spans.append((at, to.length))

        return generation
    if kind == "if":
        arms = [(_value(t), _body(b)) for t, b in node[1]]

        def choose(scope: dict, to: _Writer) -> None:
            for test, body in arms:
                if test(scope):
                    return body(scope, to)

        return choose
    name, over, body = node[1], _value(node[2]), _body(node[3])

    def loop(scope: dict, to: _Writer) -> None:
        items = over(scope) or []
        inner = dict(scope)
        for i, x in enumerate(items):
            inner[name] = x
            inner["loop"] = {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
            body(inner, to)

    return loop


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (text, spans of generated text as code points)."""
    body = _body(fold_block(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        to = _Writer()
        body({"messages": messages}, to)
        return "".join(to.parts), to.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from text that CHATML wrote."""
    turns = []
    for part in formatted.split("<|im_start|>")[1:]:
        head, _, text = part.partition("\n")
        turns.append((unescape_role(head), unescape(text.removesuffix("<|im_end|>\n"))))
    return turns


def format_chats(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """``conv_id, n_rows, formatted, spans`` for each conversation; the one shuffle is by conv_id."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [render(m) for m in part.column(1).to_pylist()]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), spans], names=["conv_id", "formatted", "spans"])

    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, spans array<struct<start:long,end:long>>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text and its spans (CHATML only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
