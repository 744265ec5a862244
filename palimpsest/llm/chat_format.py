"""Chat formatting by incremental black-box rendering.

A template is any function (turns, add_prompt) -> text; nothing is known of its inside. The operator renders
successive turn prefixes and compares consecutive outputs: what is new is the turn's span; the prompt that opens
an assistant turn and the same turn with an empty text give the head and the tail around the text, so what is
between them is the loss mask. A template that changes what it wrote for earlier turns is detected: the previous
output is no prefix of the new one. Templates that declare `local` (a turn's output depends on the turn alone)
are rendered over windows of WINDOW turns, each starting with the last turn of the one before, and that turn must
come out the same in both, so that long conversations cost linear time; all others get full prefixes.

Rows are sorted by conversation and turn inside partitions and streamed: no conversation is ever collected, a
task holds one window. A digest over a conversation is sequential by nature, so one conversation is one task's.

Cases: null text and null role are empty; ties in turn go by role, then text, nulls first; repeated rows are
repeated turns; an empty table gives no rows; a null conversation id is a conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 32
HEAD = {"user": "[INST] ", "system": "[SYS] ", "assistant": "[OUT] "}
TAIL = {"user": " [/INST]", "system": " [/SYS]", "assistant": " </s>"}
#: An opening letter of a control string inside a text gets a backslash behind it; backslashes are doubled.
_CONTROL = re.compile(r"([<\[])(?=(?:/?s>|/?(?:INST|SYS|OUT|ROLE|END)\]))|(\\)")
_ESCAPED = re.compile(r"\\(\\)|\\")
_OPEN = re.compile(r"\[(INST|SYS|OUT|ROLE)\]")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[2] else m[1] + "\\", text) if "<" in text or "[" in text or "\\" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text) if "\\" in text else text


def template(turns: list[tuple[str, str]], add_prompt: bool = False) -> str:
    """The production template."""
    out = []
    for role, text in turns:
        if role in HEAD:
            out.append(f"{HEAD[role]}{escape(text)}{TAIL[role]}")
        else:
            out.append(f"[ROLE]{escape(role)}[END] {escape(text)} </s>")
    return "".join(out) + (HEAD["assistant"] if add_prompt else "")


template.local = True


def locate(turns: list[tuple[str, str]], render, known: int = 0) -> list[tuple[str, int, int, bool]]:
    """(new text, mask start, mask end inside it, history was rewritten) for each turn from `known` on."""
    out = []
    was = render(turns[:known]) if known else ""
    for i in range(known, len(turns)):
        now = render(turns[: i + 1])
        rewrote = not now.startswith(was)
        at = len(was)
        if rewrote:
            at = next((k for k, (a, b) in enumerate(zip(was, now)) if a != b), min(len(was), len(now)))
        new, lo, hi = now[at:], 0, 0
        if turns[i][0] == "assistant":
            prompt, empty = render(turns[:i], True), render([*turns[:i], (turns[i][0], "")])
            head = len(prompt) - at
            tail = len(empty) - len(prompt)
            if now.startswith(prompt) and empty.startswith(prompt) and tail >= 0 and new.endswith(empty[len(prompt) :]) and head + tail <= len(new):
                lo, hi = head, len(new) - tail
            else:
                rewrote = True
        out.append((new, lo, hi, rewrote))
        was = now
    return out


class Reader:
    """Reads a formatted conversation back, piece by piece, from the output text alone."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rewrites = 0

    def push(self, piece: str, lo: int, hi: int):
        self.chars += len(piece)
        if hi > lo:
            said = unescape(piece[lo:hi])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        at = 0
        while at < len(piece):
            m = _OPEN.match(piece, at)
            name, at = m[1], m.end()
            if name == "ROLE":
                end = piece.index("[END] ", at)
                role, at, tail = unescape(piece[at:end]), end + 6, " </s>"
            else:
                role, at = {"INST": "user", "SYS": "system", "OUT": "assistant"}[name], at + 1
                tail = TAIL[role]
            end = piece.index(tail.strip(), at) - 1
            self.all.update(f"{role}\n{unescape(piece[at:end])}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
            at = end + len(tail)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


def _windows(rows, render):
    """(conversation, is its first turn, piece, lo, hi, rewrote) from sorted (conversation, role, text) rows."""
    local = getattr(render, "local", False)
    conv, turns, known, last = object(), [], 0, None

    def flush():
        nonlocal last, known
        got = locate(turns, render, known)
        if known:  # the shared turn must look alike in both windows
            again = locate(turns[:1], render)[0]
            if again[0] != last[0]:
                raise ValueError("the template is declared local, but a turn's output depends on the turns before it")
        for k, g in enumerate(got):
            yield (conv, known == 0 and k == 0, *g)
        last = got[-1] if got else last

    for c, role, text in rows:
        if turns and c != conv:
            yield from flush()
            turns, known = [], 0
        elif local and len(turns) >= WINDOW:
            yield from flush()
            turns, known = turns[-1:], 1
        conv = c
        turns.append((role or "", text or ""))
    if len(turns) > known:
        yield from flush()


def _sorted(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rows(batches):
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(3)))


def format_turns(conversations: DataFrame, render=template) -> DataFrame:
    """A row per turn, in order `place`: its piece of the output, its span there and the loss mask's span
    (code points), and whether the template rewrote history at it. The pieces joined are the output."""

    def run(batches):
        cols, at, place = [[] for _ in range(8)], 0, 0
        names = ["conv_id", "place", "piece", "start", "end", "mask_start", "mask_end", "rewrote"]
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
        size = 0
        for conv, first, piece, lo, hi, rewrote in _windows(_rows(batches), render):
            at, place = (0, 0) if first else (at, place + 1)
            for c, v in zip(cols, (conv, place, piece, at, at + len(piece), at + lo, at + hi, rewrote)):
                c.append(v)
            at += len(piece)
            size += len(piece)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                cols, size = [[] for _ in range(8)], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return _sorted(conversations).mapInArrow(run, "conv_id long, place long, piece string, start long, end long, mask_start long, mask_end long, rewrote boolean")


def summarise(conversations: DataFrame, render=template) -> DataFrame:
    """A row per conversation, read back from the formatted text."""

    def run(batches):
        out, reader, at = [], None, None
        for conv, first, piece, lo, hi, rewrote in _windows(_rows(batches), render):
            if first:
                if reader:
                    out.append((at, *reader.row()))
                reader, at = Reader(), conv
            reader.push(piece, lo, hi)
            reader.rewrites += rewrote
        if reader:
            out.append((at, *reader.row()))
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"])

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")


def query(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return summarise(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?(?:INST|SYS|OUT|ROLE|END)\])', '\1\\\2', 'g') AS x FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(x) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11 ELSE 17 + length(role) END)::BIGINT AS formatted_chars,
 0::BIGINT AS n_rewrites
FROM e GROUP BY conv_id
"""
