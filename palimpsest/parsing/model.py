"""What parsing one document builds: blocks, styles, records of what wasn't understood, diagnostics."""

from __future__ import annotations

from .envelope import Limits, Rejected
from .inline import PLAIN, Char

NONE, SEMANTIC, CONTENT = "none", "semantic", "content"
#: Codes that lose nothing, and codes that lose content; every wmf- code does, all others lose meaning only.
LOSSLESS = frozenset("missing-edoc decode-selected embedded-directory page-layout-summary-truncated page-geometry-summary-truncated frame-field-summary-truncated".split())
CONTENT_LOSS = frozenset(
    "decode-undecodable-bytes unterminated-edoc-opaque-tail unindexed-trailing-data frame-image-unavailable frame-anchor-out-of-range sdw-preview-too-large sdw-asset-unavailable"
    " sdw-asset-too-large preview-offset-invalid embedded-offset-invalid embedded-format-unsupported embedded-companion-unsupported embedded-asset-too-large".split()
)


def loss(code: str) -> str:
    return NONE if code in LOSSLESS else CONTENT if code in CONTENT_LOSS or code.startswith("wmf-") else SEMANTIC


class Block:
    """A node of the document tree. kind: paragraph, table, frame, annotation, footnote, header, footer, image, metafile,
    drawing or unsupported."""

    __slots__ = ("kind", "line", "text", "runs", "style", "props", "children")

    def __init__(self, kind: str, line: int, text: str = "", runs=(), style: str | None = None, children: list | None = None, **props):
        self.kind, self.line, self.text, self.runs, self.style = kind, line, text, runs, style
        self.children, self.props = children if children is not None else [], props

    def __getattr__(self, name: str):  # only reached for what isn't a slot
        return self.props.get(name)


class Style:
    __slots__ = ("name", "char", "alignment", "spacing", "left", "first", "before", "after", "shortcut", "following", "parent", "line", "ordinal")

    def __init__(self, name: str, line: int, ordinal: int):
        self.name, self.line, self.ordinal, self.char = name, line, ordinal, PLAIN
        self.alignment = self.spacing = self.left = self.first = self.before = self.after = self.shortcut = self.following = self.parent = None


class Section:
    __slots__ = ("name", "key", "line", "lines", "first")

    def __init__(self, name: str, line: int):
        self.name, self.key, self.line, self.lines, self.first = name, name.lower(), line, [], line + 1


class Document:
    def __init__(self, limits: Limits):
        self.limits = limits
        self.version = self.encoding = self.newline = self.footnotes = self.l1 = None
        self.size = self.records_made = 0
        self.metadata: dict[str, str] = {}
        self.sections: list[Section] = []
        self.styles: dict[str, Style] = {}
        self.layouts: list[dict] = []
        self.hints: list[str] = []
        self.blocks: list[Block] = []
        self.frames: list[Block] = []
        self.tables: list[dict] = []
        self.assets: list[dict] = []
        self.unknown: list[tuple[str, str, str, int]] = []
        self.diagnostics: list[tuple[str, str, str, int, str | None]] = []
        self._once: set[str] = set()

    def charge(self, n: int = 1) -> None:
        self.records_made += n
        if self.records_made > self.limits.records:
            raise Rejected("resource-limit", "records")

    def note(self, severity: str, code: str, line: int, raw: str | None = None, once: bool = False) -> None:
        if once:
            if code in self._once:
                return
            self._once.add(code)
        self.diagnostics.append((severity, code, loss(code), line, raw))

    def warn(self, code: str, line: int, raw: str | None = None) -> None:
        self.note("warning", code, line, raw)

    def record(self, section: str, kind: str, raw: str, line: int) -> None:
        self.unknown.append((section, kind, raw, line))

    def placeholder(self, kind: str, what: str, line: int) -> Block:
        return Block("unsupported", line, object=kind, description=what)

    @property
    def lossy(self) -> bool:
        return any(d[2] != NONE for d in self.diagnostics)


def usable(left, top, right, bottom) -> bool:
    """Whether a rectangle's edges and extents are within what a page can hold."""
    edges = (left, top, right, bottom)
    return None not in edges and all(-32768 <= e <= 32767 for e in edges) and 0 < right - left <= 31680 and 0 < bottom - top <= 31680


def structure_known(b: Block) -> bool:
    """Whether a frame, header or footer is understood well enough to show its content without a label."""
    if b.kind == "frame":
        return b.placement in ("anchored", "fixed-page", "repeating") and b.region in ("body", "header", "footer") and bool(b.usable)
    if not b.children:
        return True
    return b.placement in ("all", "odd", "even", "odd-even") and bool(b.terminated) and not b.unknown_bits and (b.frame is None or structure_known(b.frame))


__all__ = ["Block", "Char", "Document", "Section", "Style", "loss", "structure_known", "usable"]
