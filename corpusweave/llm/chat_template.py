"""Chat formatting with templates compiled to closures (query ``op8_chat_format``)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusweave.llm.common import table

#: Every turn is closed; what the model is trained on stands between generation tags.
TEMPLATE = (
    "{% for turn in turns %}{{ '##' + '# ' }}{{ turn.role | escape }}:\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '</turn>' + '\n' }}{% endfor %}"
)
#: Control strings of the template above. In texts the first character of each is written as a backslash and a letter, and
#: a backslash as two, so no control string can come from a text and every text can be read back.
CONTROL = re.compile(r"\\|#(?=## )|<(?=/turn>)|:(?=\n)")
WRITTEN, READ = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}, {"\\": "\\", "h": "#", "l": "<", "c": ":"}
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^:]|:(?!\n))*):\n(.*?)</turn>\n", re.S)
#: Characters of a formatted part: a longer conversation goes on in the next row.
PART_CHARS = 1 << 20
EXTRA_CONVERSATION = -7


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: WRITTEN[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: READ[m[1]], text)


class Mark(NamedTuple):
    """Begin or end of generated text in rendered output."""

    begins: bool


Piece = str | Mark
Render = Callable[[dict], Iterator[Piece]]
TOKEN = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([a-z_]+(?:\.[a-z_]+)?)|(\+|==|\|))\s*")
FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper}


class Template:
    """Compiles ``{{ value }}``, ``for``, ``if``/``else`` and ``generation`` blocks; nothing else can be named or called.

    Values are quoted strings, variables (``turns``, the loop's variable and its ``role`` and ``text``), ``+`` and filters of
    ``FILTERS``; conditions compare two values. Parsing gives a tree of tuples, ``fold`` computes what is constant and joins
    neighbouring texts, and every remaining node becomes a closure that yields text and marks. A conversation may
    be an iterator: one turn is held at a time.
    """

    def __init__(self, source: str):
        tokens, at = [], 0
        for found in TOKEN.finditer(source):
            tokens += [("text", source[at : found.start()]), ("value", found[1]) if found[1] is not None else ("tag", found[2].strip())]
            at = found.end()
        self.tokens = [t for t in [*tokens, ("text", source[at:])] if t != ("text", "")]
        self.place = 0
        self.tree = fold(self.block(frozenset({"turns"}), ()))
        self.render = compiled(self.tree)

    def block(self, names: frozenset, until: tuple) -> tuple:
        found = []
        while self.place < len(self.tokens):
            kind, body = self.tokens[self.place]
            self.place += 1
            if kind == "text":
                found.append(("const", body))
            elif kind == "value":
                found.append(("out", expression(body, names)))
            elif body in until:
                return ("seq", found)
            elif each := re.fullmatch(r"for ([a-z_]+) in ([a-z_]+)", body):
                if each[2] not in names:
                    raise ValueError(f"unknown name {each[2]}")
                inner = self.block(names | {each[1], f"{each[1]}.role", f"{each[1]}.text"}, ("endfor",))
                found.append(("for", each[1], each[2], inner))
            elif body.startswith("if "):
                test, yes, no = expression(body[3:], names), self.block(names, ("else", "endif")), ("seq", [])
                if self.tokens[self.place - 1] == ("tag", "else"):
                    no = self.block(names, ("endif",))
                found.append(("if", test, yes, no))
            elif body == "generation":
                found.append(("generation", self.block(names, ("endgeneration",))))
            else:
                raise ValueError(f"unknown tag {body!r}")
        if until:
            raise ValueError(f"missing {until[-1]}")
        return ("seq", found)


def expression(source: str, names: frozenset) -> tuple:
    """Left to right: ``==`` binds least, then ``+``, then filters."""
    left, equal, right = split_equal(source)
    if equal:
        return ("equal", expression(left, names), expression(right, names))
    at, node, joining = 0, None, False
    while at < len(source):
        part = VALUE.match(source, at)
        if not part or part.end() == at:
            raise ValueError(f"cannot read {source[at:]!r}")
        at = part.end()
        if part[3] == "+" and node is not None:
            joining = True
            continue
        if part[3] == "|" and node is not None:
            name = VALUE.match(source, at)
            if not name or name[2] not in FILTERS:
                raise ValueError(f"unknown filter in {source!r}")
            at, last = name.end(), node[2] if node[0] == "join" else node
            applied = ("filter", name[2], last)
            node = ("join", node[1], applied) if node[0] == "join" else applied
            continue
        if part[3] or (node is not None and not joining):
            raise ValueError(f"cannot read {source!r}")
        value = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), part[1])) if part[1] is not None else ("name", part[2])
        if value[0] == "name" and value[1] not in names:
            raise ValueError(f"unknown name {value[1]}")
        node, joining = (("join", node, value) if joining else value), False
    if node is None or joining:
        raise ValueError(f"cannot read {source!r}")
    return node


def split_equal(source: str) -> tuple[str, str, str]:
    """At the first ``==`` outside quotes."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", lambda m: "'" + "x" * (len(m[0]) - 2) + "'", source)
    at = bare.find("==")
    return (source, "", "") if at < 0 else (source[:at], "==", source[at + 2 :])


def fold(node: tuple) -> tuple:
    """The same tree with constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "seq":
        out: list[tuple] = []
        for part in map(fold, node[1]):
            for p in part[1] if part[0] == "seq" else [part]:
                if p[0] == "const" and out and out[-1][0] == "const":
                    out[-1] = ("const", out[-1][1] + p[1])
                elif p != ("const", ""):
                    out.append(p)
        return ("seq", out)
    if kind == "out":
        return inner if (inner := fold(node[1]))[0] == "const" else ("out", inner)
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind in ("join", "equal"):
        left, right = fold(node[1]), fold(node[2])
        if left[0] == right[0] == "const":
            return ("const", left[1] + right[1] if kind == "join" else left[1] == right[1])
        return (kind, left, right)
    if kind == "if":
        test = fold(node[1])
        return fold(node[2] if test[1] else node[3]) if test[0] == "const" else ("if", test, fold(node[2]), fold(node[3]))
    return (*node[:-1], fold(node[-1]))


def compiled(node: tuple) -> Render:
    kind = node[0]
    if kind == "const":
        return lambda env: iter((node[1],))
    if kind == "seq":
        parts = [compiled(p) for p in node[1]]
        return lambda env: (piece for part in parts for piece in part(env))
    if kind == "out":
        value = evaluated(node[1])
        return lambda env: iter((value(env),))
    if kind == "if":
        test, yes, no = evaluated(node[1]), compiled(node[2]), compiled(node[3])
        return lambda env: yes(env) if test(env) else no(env)
    if kind == "generation":
        inner = compiled(node[1])

        def marked(env: dict) -> Iterator[Piece]:
            yield Mark(True)
            yield from inner(env)
            yield Mark(False)

        return marked
    _, name, over, body = node
    each = compiled(body)
    return lambda env: (piece for item in env[over] for piece in each(env | {name: item}))


def evaluated(node: tuple) -> Callable[[dict], str | bool]:
    kind = node[0]
    if kind == "const":
        return lambda env: node[1]
    if kind == "name":
        name, _, field = node[1].partition(".")
        return (lambda env: env[name][field]) if field else (lambda env: env[name])
    if kind == "filter":
        apply, inner = FILTERS[node[1]], evaluated(node[2])
        return lambda env: apply(inner(env))
    left, right = evaluated(node[1]), evaluated(node[2])
    return (lambda env: left(env) + right(env)) if kind == "join" else (lambda env: left(env) == right(env))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its turns) from rows sorted by conversation and turn, one row at a time."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for conv_id, own in groupby(rows, key=lambda r: r[0]):
        yield conv_id, ({"role": role or "", "text": text or ""} for _, role, text in own)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, part, formatted, loss_spans``: each conversation of ``turns`` (``conv_id, turn, role, text``) rendered.

    Rows of a conversation come together sorted by turn (missing ones first), then role and text, and stream through the
    template: what a task holds is a turn and a part of at most about ``PART_CHARS`` characters, however long a conversation
    is; parts of one conversation follow each other. ``loss_spans`` are the places of generated text in the part. Null
    roles and texts are empty, rows without conv_id are one conversation, repeated rows are repeated turns.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn").cast("long"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct({"start": pa.int32(), "stop": pa.int32()}))]
    names = ["conv_id", "part", "formatted", "loss_spans"]

    def run(batches):
        render, held, size = Template(template).render, [], 0
        for conv_id, own in _conversations(batches):
            part, text, at, spans, begun = 0, [], 0, [], None
            for piece in render({"turns": own}):
                if isinstance(piece, Mark):
                    if piece.begins:
                        begun = at
                    else:
                        spans.append({"start": begun, "stop": at})
                        begun = None
                    continue
                text.append(piece)
                at += len(piece)
                if at >= PART_CHARS and begun is None:
                    held.append((conv_id, part, "".join(text), spans))
                    part, text, size, at, spans = part + 1, [], size + at, 0, []
            if text or not part:
                held.append((conv_id, part, "".join(text), spans))
                size += at
            if size >= PART_CHARS:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return rows.mapInArrow(run, "conv_id long, part int, formatted string, loss_spans array<struct<start: int, stop: int>>")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of conversations parsed back from ``format_conversations``, whose rows' order it relies on."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        state, rows = None, []
        for batch in batches:
            for conv_id, part, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or part == 0:
                    if state is not None:
                        rows.append(closed(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
                state[5] += len(text)
                for span in spans:
                    loss = unescape(text[span["start"] : span["stop"]])
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
                text, at = state[6] + text, 0
                for turn in TURN.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode("utf-8", "surrogatepass"))
                    at = turn.end()
                state[6] = text[at:]  # a turn may go on in the next part
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if state is not None:
            rows = [closed(state)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def closed(state):
        if state[6]:
            raise ValueError(f"conversation {state[0]} cannot be read back")
        return (*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(EXTRA_CONVERSATION, 0, "user", said), (EXTRA_CONVERSATION, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_conversations(format_conversations(given.unionByName(extra)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>'), ':' || chr(10), '\c' || chr(10)) AS written,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>'), ':' || chr(10), '\c' || chr(10)) AS name
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(name) + length(written) + 14)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
