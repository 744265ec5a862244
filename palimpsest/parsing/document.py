"""One document: bytes in, a Document out, or Rejected with a code."""

from __future__ import annotations

import hashlib
import re

from . import envelope, records, streams
from .envelope import Limits, Rejected
from .model import Document, Section

_NAME = re.compile(rf"\[({envelope.NAME})\]\s*")


def parse(data: bytes, limits: Limits = Limits(), encoding: str | None = None) -> Document:
    if not data:
        raise Rejected("empty")
    src = envelope.decode(data, limits, encoding)
    lines = src.lines
    start = next((k for k, x in enumerate(lines[:4097]) if x.strip().lower() == "[ver]"), None)
    if start is None or src.starts[start] > 4096:
        raise Rejected("no-version-section")
    if start and not any(x.strip().lower() == "[sty]" for x in lines[start + 1 : start + 6]):
        raise Rejected("no-style-section", "after a preamble")
    doc = Document(limits)
    doc.encoding, doc.newline, doc.size = src.encoding, src.newline, len(data)
    if src.undecodable:
        doc.warn("decode-undecodable-bytes", 0)
    if src.reason != "override":
        doc.note("info", "decode-selected", 0, src.reason)
    if src.pointer_ok is False:
        doc.warn("embedded-directory-pointer-mismatch", 0)
    if start:
        doc.warn("leading-preamble", 0, "\n".join(lines[:start]))
    tail = _sections(doc, src, start)
    records.metadata(doc)
    if doc.version is None:
        raise Rejected("no-version")
    if not any(s.key == "sty" for s in doc.sections):
        raise Rejected("no-style-section")
    anchors, extra = records.structures(doc, data, src, src.starts[start])
    body = next((s for s in doc.sections if s.key == "edoc"), None)
    if body is None:
        doc.warn("missing-edoc", 0)
    else:
        streams.stream(doc, body.lines, body.first, doc.blocks, anchors)
    doc.anchors = anchors.log
    if tail:
        a, b = tail
        what = f"{b - a} bytes after a NUL in a body without a close; SHA-256 {hashlib.sha256(data[a:b]).hexdigest()}"
        doc.blocks.append(doc.placeholder("unterminated EDOC opaque tail", what, 0))
        doc.warn("unterminated-edoc-opaque-tail", 0, what)
    for n, f in enumerate(anchors.frames):
        if n not in anchors.used:
            doc.blocks += [doc.placeholder("unplaced anchored frame", f"anchor {n} is not in the body; the frame follows", f.line), f]
            doc.warn("unreferenced-anchored-frame", f.line, str(n))
    doc.blocks += extra
    lost = sum(b - a for a, b in src.gaps if data[a:b].strip(b"\0\r\n\t \x1a"))
    if lost:
        doc.warn("unindexed-trailing-data", 0, str(lost))
        doc.blocks.append(doc.placeholder("unindexed trailing data", f"{lost} bytes after the body belong to no indexed payload", 0))
    records.unknown_sections(doc)
    doc.source = src
    return doc


def _sections(doc: Document, src: envelope.Source, start: int) -> tuple[int, int] | None:
    """Cuts the lines into sections. A body without a close ends at a line with a NUL, and what follows up to a
    directory is returned as a span of bytes."""
    lines, skip, opaque = src.lines, range(0), None
    if not src.closed:
        low = [x.strip().lower() for x in lines]
        edoc = next((k for k in range(start, len(low)) if low[k] == "[edoc]"), None)
        if edoc is not None and envelope.closing_line(lines, edoc + 1) < 0:
            nul = next((k for k in range(edoc + 1, len(lines)) if "\0" in lines[k]), None)
            if nul is not None:
                back = next((k for k in range(len(low) - 1, nul, -1) if low[k] == "[embedded]"), len(lines))
                skip = range(nul + 1, back)
                if skip:
                    opaque = (src.starts[skip.start], src.starts[back] if back < len(lines) else doc.size)
    current = None
    for k in range(start, len(lines)):
        if k in skip:
            continue
        x = lines[k]
        if x.startswith("[") and (m := _NAME.fullmatch(x)):
            current = Section(m[1], k)
            doc.sections.append(current)
            if len(doc.sections) > doc.limits.records:
                raise Rejected("resource-limit", "sections")
        elif current is not None:
            current.lines.append(x)
    return opaque
