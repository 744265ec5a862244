"""Text streams: blank lines end paragraphs, containers nest, anchors put frames where they stand, a > closes."""

from __future__ import annotations

import re

from .envelope import Containers, Rejected
from .inline import PLAIN, State, integer, parse
from .model import Block, Document

_ANCHOR = re.compile(r"(?<!<)<:([tA])(\d+)>")
_NAMES = {"N": "annotation", "F": "footnote", "H": "header", "h": "footer"}


def paragraph(doc: Document, text: str, line: int, state: State | None = None) -> Block:
    if state is None and "<" not in text and "@" not in text:  # nothing changes the state
        s = doc.styles.get("Body Text")
        b = Block("paragraph", line, text, [(text, s.char if s else PLAIN)] if text else [], "Body Text" if s else None, alignment=s.alignment if s else None, spacing=s.spacing if s else None, region=None, indents=None, page_break=False, list_kind=None)
        doc.charge(1 + len(b.runs))
        return b
    state = state or State(doc.styles)
    shown, runs = parse(text, state, lambda severity, code, raw, once=False: doc.note(severity, code, line, raw, once), lambda section, kind, raw: doc.record(section, kind, raw, line))
    doc.charge(1 + len(runs))
    low = state.style.lower() if state.style else ""
    kind = "bullet" if "bullet" in low else "number" if "number" in low else None
    b = Block("paragraph", line, shown, runs, state.style, alignment=state.alignment, spacing=state.spacing, region=state.region, indents=state.indents, page_break=state.page_break, list_kind=kind)
    if shown or runs:
        state.page_break = False
    return b


def paragraphs(doc: Document, lines: list[str], line: int) -> list[Block]:
    """Plain text without containers or anchors, as in cells and frames."""
    out, part, first = [], [], line
    for k, x in enumerate([*lines, ""]):
        if x:
            if not part:
                first = line + k
            part.append(x)
        elif part:
            out.append(paragraph(doc, "".join(part), first))
            part = []
    return out


def placement(flags: int | None) -> str:
    """Which pages a header or footer is for."""
    if flags is None:
        return "unknown"
    odd, even = bool(flags & 4), bool(flags & 8)
    return "odd-even" if flags & 16 or (odd and even) else "odd" if odd else "even" if even else "all"


class Anchors:
    """The anchored frames in source order, and which are placed."""

    def __init__(self, frames: list[Block] = ()):
        self.frames, self.used = list(frames), set()
        self.log: list[tuple[str, int, int, str]] = []

    def resolve(self, doc: Document, kind: str, digits: str, line: int) -> list[Block]:
        if len(digits) > 20:
            raise Rejected("resource-limit", "frame anchor digits")
        n, name = int(digits), f"{kind}{digits}"
        if n >= len(self.frames):
            result, code, shown = "out-of-range", "frame-anchor-out-of-range", [doc.placeholder("missing frame anchor", f"anchor {name} has no frame", line)]
        elif n in self.used:
            result, code, shown = "duplicate", "duplicate-frame-anchor", [doc.placeholder("duplicate frame anchor", f"anchor {name} was placed before", line)]
        else:
            self.used.add(n)
            f = self.frames[n]
            result, code, shown = "placed", None, [f]
            if (kind == "t") != bool(f.is_table):
                result, code = "kind-mismatch", "frame-anchor-kind-mismatch"
                shown = [doc.placeholder("frame anchor mismatch", f"anchor {name} is for another kind of frame", line), f]
        if code:
            doc.warn(code, line, name)
        self.log.append((kind, min(n, 2**62), line, result))
        return shown


class _Open:
    __slots__ = ("kind", "line", "metadata", "raw", "children")

    def __init__(self, kind, line, metadata, raw):
        self.kind, self.line, self.metadata, self.raw, self.children = kind, line, metadata, raw, []


def _finish(doc: Document, o: _Open, terminated: bool, label: str) -> Block:
    name, meta = _NAMES[o.kind], o.metadata.strip()
    doc.record(label, f"multiline-{name}", "\n".join(o.raw), o.line)
    if not terminated:
        doc.warn(f"unterminated-{name}", o.line)
    if o.kind == "N":
        if not re.fullmatch(r"[+-]?\d+", meta):
            doc.warn("annotation-metadata-opaque", o.line, meta)
        return Block(name, o.line, children=o.children, metadata=meta, terminated=terminated)
    if o.kind == "F":
        if o.metadata:
            doc.warn("footnote-metadata-unsupported", o.line, meta)
        return Block(name, o.line, children=o.children, metadata=meta, terminated=terminated)
    flags = integer(meta, -(10**20), 10**20)
    bits = flags & ~0x1F if flags is not None else 0
    if flags is None:
        doc.warn(f"{name}-placement-unsupported", o.line, meta)
    elif bits:
        doc.warn(f"{name}-unknown-flag-bits", o.line, meta)
    if flags is not None and flags & (1 if o.kind == "H" else 2):
        doc.warn("header-footer-kind-flag-mismatch", o.line, meta)
    return Block(name, o.line, children=o.children, metadata=meta, terminated=terminated, flags=flags, unknown_bits=bits, placement=placement(flags), origin="body")


def stream(doc: Document, lines: list[str], first: int, out: list[Block], anchors: Anchors | None = None, label: str = "edoc", closes: bool = True) -> bool:
    """Adds the stream's blocks to out; returns whether a close ended it. first: number of the first line."""
    anchors = anchors or Anchors()
    containers = Containers()
    scan = containers.scan
    stack: list[_Open] = []
    part: list[str] = []
    start, closed = first, False

    def flush() -> None:
        nonlocal part
        if not part:
            return
        text, part = "\n".join(part), []
        target = stack[-1].children if stack else out
        state, at = State(doc.styles), 0
        if "<:" in text:
            for m in _ANCHOR.finditer(text):
                if before := text[at : m.start()]:
                    add(before, state, target)
                target.extend(anchors.resolve(doc, m[1], m[2], start))
                doc.charge()
                at = m.end()
        if at == 0 or text[at:]:
            add(text[at:], state, target)

    def add(text: str, state: State, target: list[Block]) -> None:
        b = paragraph(doc, text.replace("\n", "") if "\n" in text else text, start, state)
        if b.text or b.runs:
            target.append(b)

    def pop(terminated: bool) -> None:
        flush()
        done = _finish(doc, stack.pop(), terminated, label)
        (stack[-1].children if stack else out).append(done)

    for k, line in enumerate(lines, first):
        if not line:
            if stack:
                stack[-1].raw.append(line)
            flush()
            continue
        if not containers.field and "<" not in line and ">" not in line:
            if stack:
                stack[-1].raw.append(line)
            if not part:
                start = k
            part.append(line)
            continue
        opener, close = scan(line)
        if close:
            if not stack:
                flush()
                closed = True
                break
            stack[-1].raw.append(line)
            pop(True)
            continue
        if line.lstrip().startswith(">"):
            doc.warn("malformed-container-terminator" if stack else "malformed-edoc-terminator", k, line)
        if stack:
            stack[-1].raw.append(line)
        if opener:
            if before := line[: opener.start()]:
                if not part:
                    start = k
                part.append(before)
            flush()
            if len(stack) >= doc.limits.depth:
                raise Rejected("resource-limit", "container depth")
            doc.charge(2)
            kind = opener[1]
            if stack and (kind in "Hh" or stack[-1].kind in "Hh"):
                doc.warn("unsupported-nested-header-footer", k)
            stack.append(_Open(kind, k, line[opener.end() :], [line[opener.start() :]]))
        else:
            if not part:
                start = k
            part.append(line)
    while stack:
        pop(False)
    flush()
    if not closed and closes:
        doc.warn("unterminated-edoc", first)
    return closed
