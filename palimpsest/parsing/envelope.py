"""Bytes to text: code page, line table, end of the body, verified payload spans and what no span covers."""

from __future__ import annotations

import codecs
import re
from bisect import bisect_right
from dataclasses import dataclass, field, fields, replace
from functools import lru_cache
from itertools import accumulate

MB = 1024 * 1024


#: The name of a section or sub-record.
NAME = r"(?a:[A-Za-z][\w-]{0,63})"


class Rejected(Exception):
    """A document that can't be parsed; its code becomes the row's error."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail or code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Ceilings for one document. A caller can lower them, never raise them."""

    file_bytes: int = 64 * MB
    line_bytes: int = 4 * MB
    lines: int = 1_000_000
    records: int = 1_000_000
    depth: int = 64
    styles: int = 10_000
    table_cells: int = 100_000
    asset_bytes: int = 16 * MB
    total_asset_bytes: int = 64 * MB
    wmf_pixels: int = 4_000_000
    total_wmf_pixels: int = 8_000_000
    sdw_pixels: int = 4_000_000
    total_sdw_pixels: int = 8_000_000
    embedded_records: int = 4_096

    def lowered(self, **given: int) -> Limits:
        known = {f.name for f in fields(self)}
        for name, value in given.items():
            if name not in known or isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{name}={value!r} is no limit; there are {', '.join(sorted(known))}, whole and not negative")
        return replace(self, **{n: min(v, getattr(self, n)) for n, v in given.items()})


# --- commands and containers over lines ----------------------------------------------------------------------

_PLAIN_END = re.compile(r"<;>|<\[>|<[/\\].>|(>)")
_QUOTED_END = re.compile(r'<;>|<\[>|<[/\\].>|(>)|(")')
_OPENER = re.compile(r"<:([NFHh])(?=$|[^A-Za-z])")
_LOOSE_OPENER = re.compile(r"<:([NFHh])")
_STRUCTURE = re.compile(r"(?<!<)<:(?:([NFHh])|[XZ])")


def command_end(line: str, start: int, quoted: bool, inside: bool = False) -> tuple[int, bool]:
    """Place of the > that ends a command whose content begins at start (-1: none), and whether a quote is open.
    Escaped characters don't end it, and between quotes nothing does."""
    for m in (_QUOTED_END if quoted else _PLAIN_END).finditer(line, start):
        if quoted and m[2]:
            inside = not inside
        elif m[1] and not inside:
            return m.start(), inside
    return -1, inside


class Containers:
    """Finds, line by line, what opens a multi-line container and the > lines that close one. A dynamic field may go on
    over several lines, and nothing in it opens or closes anything."""

    def __init__(self):
        self.field = self.quote = False

    def scan(self, line: str) -> tuple[re.Match | None, bool]:
        """(the opener in this line, whether the line is a close)."""
        if not self.field and "<" not in line:
            return None, line.strip() == ">"
        at, went_on = 0, self.field
        if went_on:
            end, self.quote = command_end(line, 0, True, self.quote)
            if end < 0:
                return None, False
            self.field = self.quote = False
            at = end + 1
        while (at := line.find("<", at)) >= 0:
            if line.startswith("<<", at):
                at += 2
                continue
            if m := _OPENER.match(line, at):
                return m, False
            dynamic = line.startswith(("<:X", "<:Z"), at)
            end, quote = command_end(line, at + 1, dynamic)
            if end >= 0:
                at = end + 1
                continue
            if m := _LOOSE_OPENER.match(line, at):  # never closed, so it is a damaged container
                return m, False
            if not dynamic:
                m = _STRUCTURE.search(line, at + 1)
                if not m:
                    break
                if m[1]:
                    return m, False
                quote = command_end(line, m.start() + 1, True)[1]
            self.field, self.quote = True, quote
            return None, False
        return None, not went_on and line.strip() == ">"


def closing_line(lines: list[str], start: int) -> int:
    """Number of the line that closes the stream which begins at start; -1 where none does."""
    depth, c = 0, Containers()
    for k in range(start, len(lines)):
        x = lines[k]
        if not c.field and ">" not in x and "<" not in x:
            continue
        opener, close = c.scan(x)
        if close:
            if not depth:
                return k
            depth -= 1
        elif opener:
            depth += 1
    return -1


# --- code pages ----------------------------------------------------------------------------------------------

_MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_CHARSET = re.compile(rb"(?im)^[ \t]*\[charset\][ \t]*\r?$(?P<body>.*?)(?=^\[|\Z)", re.S)
_PAGE = re.compile(rb"CP\s*(\d{3,5})", re.I)
_PAGES = {932: "cp932", 10000: "mac_roman", 65001: "utf-8"}


def choose_codec(data: bytes, override: str | None, evidence_end: int) -> tuple[str, int, str]:
    """(codec, bytes of a byte order mark, why): the override; a mark; a code page that [charset] names; UTF-8 where the text
    is valid and not plain ASCII; else the Western Windows page. What follows the body is no evidence."""
    if override:
        try:
            name = codecs.lookup(override).name
        except LookupError:
            raise Rejected("unknown-encoding", override) from None
        if name == "utf-8-sig":
            return "utf-8", 3 if data.startswith(codecs.BOM_UTF8) else 0, "override"
        if name in ("utf-16", "utf-32"):
            for mark, full in _MARKS:
                if full.startswith(name) and data.startswith(mark):
                    return full, len(mark), "override"
            raise Rejected("unknown-encoding", f"{name} without a byte order mark")
        return name, 0, "override"
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name, len(mark), "mark"
    section = _CHARSET.search(data, 0, min(evidence_end, 65536))  # a header section, far before this
    if section and (page := _PAGE.search(section["body"])):
        try:
            return codecs.lookup(_PAGES.get(int(page[1]), f"cp{int(page[1])}")).name, 0, "charset"
        except LookupError:
            pass
    if data[:evidence_end].isascii():
        return "cp1252", 0, "ascii"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(memoryview(data)[:evidence_end], True)
    except UnicodeDecodeError:
        return "cp1252", 0, "default"
    return "utf-8", 0, "utf-8"


def body_end(data: bytes) -> tuple[int, list[str] | None]:
    """(byte after the line that closes the body, the lines up to it), all bytes where none does. Structure is ASCII, so
    Latin-1 finds it; where the text is ASCII the lines are those of every single-byte page."""
    if not re.search(rb"(?i)\[edoc\]", data):
        return len(data), None
    text = data.decode("latin-1")
    lines = text.splitlines()
    start = next((k for k, x in enumerate(lines) if x[:1] in "[ \t" and x.strip().lower() == "[edoc]"), None)
    close = closing_line(lines, start + 1) if start is not None else -1
    if close < 0:
        return len(data), None
    if close + 1 == len(lines):
        return len(data), lines
    return sum(map(len, text.splitlines(True)[: close + 1])), lines[: close + 1]


# --- appended payloads ---------------------------------------------------------------------------------------

_DIGITS = r"\d{1,20}"
#: A directory row: number, suffix, place and size of the asset and of its companion.
ROW = re.compile(r"\s*" + r"\s+".join(f"(?P<{n}>{p})" for n, p in (("id", _DIGITS), ("ext", r"\.[A-Za-z0-9]{1,8}"), ("at", _DIGITS), ("size", _DIGITS), ("preview_at", _DIGITS), ("preview_size", _DIGITS))) + r"\s*")
DIRECTORIES = 8


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def between(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of [start, end) no span covers; spans are merged."""
    edges = [start, *(x for s in spans for x in s), end]
    return [(max(a, start), b) for a, b in zip(edges[::2], edges[1::2]) if max(a, start) < b]


def inside_one(spans: list[tuple[int, int]], at: int, size: int) -> bool:
    """Whether [at, at + size) lies in one merged span."""
    k = bisect_right(spans, (at, 1 << 70)) - 1
    return size > 0 and k >= 0 and at + size <= spans[k][1]


@lru_cache(64)
def _marker(codec: str) -> re.Pattern:
    either = lambda c: b"(?:" + b"|".join({re.escape(x.encode(codec)) for x in (c, c.upper())}) + b")"
    return re.compile(b"".join(map(either, "[embedded]")))


@dataclass
class Source:
    """A decoded document. lines: header, body and directory, without line breaks; starts: byte of each."""

    text: str
    encoding: str
    reason: str
    newline: str
    lines: list[str]
    starts: list[int]
    undecodable: int
    spans: list[tuple[int, int]] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)
    pointer_ok: bool | None = None
    tail: int | None = None
    directory_line: int | None = None
    closed: bool = False


def _directory(data: bytes, codec: str, tail: int, base: int, limits: Limits):
    """(first byte, lines, spans, whether the last line points at it) of the last valid directory after the body."""
    marks = [m.start() for m in _marker(codec).finditer(data, tail) if any(data[: m.start()].endswith(n.encode(codec)) for n in "\r\n")]
    for at in reversed(marks[-DIRECTORIES:]):
        rows = data[at:].decode(codec, "surrogateescape" if not codec.startswith("utf-") or codec == "utf-8" else "replace").splitlines()
        if rows[0].strip().lower() != "[embedded]":
            continue
        if len(rows) > min(limits.records, limits.embedded_records) + 2:
            raise Rejected("resource-limit", "embedded directory")
        found, spans = 0, []
        for r in rows[1:]:
            if m := ROW.fullmatch(r):
                found += 1
                for a, n in ((m["at"], m["size"]), (m["preview_at"], m["preview_size"])):
                    lo, n = base + int(a), int(n)
                    if n and tail <= lo and lo + n <= at:
                        spans.append((lo, lo + n))
        last = next((r.strip() for r in reversed(rows[1:]) if r.strip()), "")
        pointer = bool(re.fullmatch(r"\d{1,20}", last)) and int(last) == at - base
        if found or pointer:
            return at, rows, merged(spans), pointer
    return None


def decode(data: bytes, limits: Limits, encoding: str | None = None) -> Source:
    if len(data) > limits.file_bytes:
        raise Rejected("resource-limit", "file bytes")
    marked = any(data.startswith(m) for m, _ in _MARKS)
    end, ready = (len(data), None) if encoding or marked else body_end(data)
    codec, mark, reason = choose_codec(data, encoding, end)
    wide = 4 if codec.startswith("utf-32") else 2 if codec.startswith("utf-16") else 1
    # single-byte pages: the body's end is known, so payloads aren't decoded at all
    part = data[mark : end if wide == 1 and not encoding else len(data)]
    replaced = 0
    single = wide == 1 and codec not in ("utf-8", "cp932")
    size = len if single else lambda x: len(x.encode(codec, "surrogateescape"))
    if ready is not None and single and part.isascii():
        text, lines, closed = part.decode("ascii"), ready, True
    else:
        try:
            text = part.decode(codec, "surrogateescape")
        except UnicodeDecodeError:
            text, replaced = part.decode(codec, "replace"), 1
        except LookupError:
            raise Rejected("unknown-encoding", codec) from None
        lines = text.splitlines()
        start = next((k for k, x in enumerate(lines) if x[:1] in "[ \t" and x.strip().lower() == "[edoc]"), None)
        close = closing_line(lines, start + 1) if start is not None else -1
        closed = close >= 0
        if closed:
            lines = lines[: close + 1]
    whole = text.splitlines(True)[: len(lines)]
    if len(lines) > limits.lines:
        raise Rejected("resource-limit", "lines")
    sizes = list(map(size, whole))
    if sizes and max(sizes) > limits.line_bytes:
        raise Rejected("resource-limit", "line bytes")
    starts = list(accumulate(sizes, initial=mark))
    at = starts.pop()
    base = next((a for a, line in zip(starts, lines) if line[:1] in "[ \t" and line.strip().lower() == "[ver]"), None)
    kept = text if at == mark + len(text) and single else "".join(whole)
    src = Source(kept, codec, reason, "\r\n" if "\r\n" in kept else "\n" if "\n" in kept else "\r", lines, starts, replaced, closed=closed)
    if closed and at < len(data):
        src.tail = at
        found = _directory(data, codec, at, base if base is not None else mark, limits)
        stop = found[0] if found else len(data)
        if found:
            src.spans, src.pointer_ok, src.directory_line = found[2], found[3], len(lines)
            for row in found[1]:
                src.lines.append(row)
                src.starts.append(stop)
                stop += size(row)
            stop = found[0]
        src.gaps = between(at, stop, src.spans)
        rest = b"".join(data[a:b] for a, b in src.gaps).decode(codec, "replace").splitlines(True)
        if len(rest) + len(src.lines) > limits.lines or any(size(x) > limits.line_bytes for x in rest if len(x) * 4 > limits.line_bytes):
            raise Rejected("resource-limit", "lines after the body")
    src.undecodable = replaced + sum(1 for c in _lone.findall(kept)) if not kept.isascii() else replaced
    if src.undecodable:
        src.lines = [_lone.sub("�", x) for x in src.lines]
    return src


_lone = re.compile("[\udc80-\udcff]")
