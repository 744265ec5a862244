"""Scalar column functions of the document format: casts, escapes, units, bit fields, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TWIPS_PER_INCH, TWIPS_PER_POINT = 1440, 20


def bounded_int(c: Column, limit: int = 2**31 - 1) -> Column:
    """The integer that a field of up to 20 digits states, else null; null too beyond +-limit."""
    n = F.when(c.rlike(r"^[+-]?[0-9]{1,20}$"), c.try_cast("decimal(20,0)"))
    return F.when(F.abs(n) <= limit, n).cast("long")


def too_many_digits(c: Column) -> Column:
    """Whether a numeric field is so long that its document must be refused."""
    return c.rlike(r"^[+-]?[0-9]{21,}$")


def points(twips: Column) -> Column:
    return twips.cast("double") / TWIPS_PER_POINT


def inches(twips: Column) -> Column:
    return twips.cast("double") / TWIPS_PER_INCH


def line_spacing(n: Column) -> Column:
    """-1, -2, -3 are single, one and a half, double; other values are twentieths of a point."""
    return F.when(n == -1, 1.0).when(n == -2, 1.5).when(n == -3, 2.0).otherwise(n.cast("double") / TWIPS_PER_POINT)


def colour(packed: Column) -> Column:
    """#rrggbb of a packed colour: red in the low byte, then green, then blue."""
    byte = lambda k: F.lower(F.lpad(F.hex(F.shiftright(packed.cast("long"), 8 * k).bitwiseAND(255)), 2, "0"))
    return F.concat(F.lit("#"), byte(0), byte(1), byte(2))


def has_bit(flags: Column, bit: int) -> Column:
    return flags.cast("long").bitwiseAND(F.lit(bit).cast("long")) != 0


def font_flags(flags: Column) -> Column:
    """The marks of a style's flag word; any of three bits underlines."""
    names = {"bold": 1, "italic": 2, "underline": 4 | 8 | 64, "strike": 128, "superscript": 256, "subscript": 512}
    return F.struct(*[has_bit(flags, b).alias(n) for n, b in names.items()])


def placement(flags: Column) -> Column:
    """Which pages a header or footer is for."""
    odd, even = has_bit(flags, 4), has_bit(flags, 8)
    return F.when(flags.isNull(), "unknown").when(has_bit(flags, 16) | (odd & even), "odd-even").when(odd, "odd").when(even, "even").otherwise("all")


def paper(flags: Column) -> Column:
    """Struct of a page layout's flag word."""
    f = flags.cast("long")
    code = f.bitwiseAND(F.lit(255).cast("long"))
    known = 255 | 256 | 512 | 1024 | 2048 | 4096
    return F.struct(F.when(code.between(1, 7), code).alias("paper_code"), F.when(has_bit(f, 256), "landscape").otherwise("portrait").alias("orientation"), (~has_bit(f, 512)).alias("alternating"), has_bit(f, 1024).alias("mirrored"), has_bit(f, 2048).alias("second_header"), has_bit(f, 4096).alias("second_footer"), f.bitwiseAND(F.lit(~known).cast("long")).alias("unknown_bits"))


def heading_level(style: Column) -> Column:
    """1 to 6 from a style's name, else null."""
    s = F.lower(F.regexp_replace(F.trim(style), r"\s+", " "))
    n = F.regexp_extract(s, r"\b(?:heading|head|h)\s*[-_:]?\s*([1-6])\b", 1)
    return F.when(n != "", n.cast("int")).when(s.isin("title", "document title", "chapter title", "chapter heading", "heading", "head"), 1).when(s.isin("subtitle", "sub title", "subhead", "subheading"), 2)


def region_margins(x: Column, width: Column, container: Column, tolerance: int = 3) -> Column:
    """Left, right and first-line margin of a region inside its container. A region as wide as the container states where the
    first line begins; one that overflows can't be applied and is null."""
    end = x + width
    full = F.abs(width - container) <= tolerance
    bad = (x < 0) | (width <= 0) | (container <= 0) | (~full & ((x >= container) | (end > container + tolerance)))
    m = F.struct(F.when(full, 0).otherwise(x).cast("long").alias("left"), F.when(full, 0).otherwise(F.greatest(F.lit(0), container - end)).cast("long").alias("right"), F.when(full, x).otherwise(0).cast("long").alias("first"))
    return F.when(~bad, m)


def encode_escapes(text: Column) -> Column:
    """Text as it is written in a body; the order of the replacements matters."""
    for a, b in ((">", "\x00"), ("<", "<<"), ("[", "<[>"), ("\x00", "<;>"), ("@", "@@")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shifted(token: Column) -> Column:
    """The character of a shifted control: </x> adds 0x40 to the code (mod 256), <\\x> sets 0x80."""
    kind, code = F.substring(token, 2, 1), F.ascii(F.substring(token, 3, 1))
    return F.when(kind == "/", F.char((code + 64).bitwiseAND(255))).otherwise(F.char(code.bitwiseOR(F.lit(128))))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "�")


def escape_markdown(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"([\\`*_\[\]{}|])", r"\\$1")


def normalize_text(text: Column, policy: str = "exact") -> Column:
    """Line breaks made one kind; then as it is, without trailing breaks, or with white space collapsed."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    if policy == "exact":
        return t
    if policy == "trailing-newline":
        return F.regexp_replace(t, "\n+$", "")
    if policy == "collapse":
        return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    raise ValueError(f"unknown policy {policy!r}; there are collapse, exact, trailing-newline")


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in Unicode form C with white space collapsed."""
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()))

    return F.sha2(composed(text), 256)


def sanitize(text: Column, longest: int = 1024, combining: int = 64) -> Column:
    """Text that standard fonts can set: other planes, non-characters, controls and format controls become U+FFFD, runs of
    combining marks and of characters without white space are bounded, with a mark where something is left out."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        bidi = {0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}

        def one(x):
            out, marks, token = [], 0, 0
            for c in x.replace("\r\n", "\n").replace("\r", "\n"):
                n, kind = ord(c), unicodedata.category(c)
                if c not in "\n\t" and (n > 0xFFFF or 0xFDD0 <= n <= 0xFDEF or n in (0xFFFE, 0xFFFF) or kind == "Cc" or (kind == "Cf" and n not in bidi)):
                    c = "\ufffd"
                marks = marks + 1 if unicodedata.combining(c) else 0
                if marks > combining:
                    if marks > combining + 1:
                        continue
                    c = "\ufffd"
                token = 0 if c.isspace() else token + 1
                if token <= longest:
                    out.append(c)
                elif token == longest + 1:
                    out.append("[...]")
            return "".join(out)

        return s.map(lambda x: None if x is None else one(x) if not (x.isascii() and x.isprintable() and len(x) <= longest) else x)

    return run(text)


def direction(text: Column) -> Column:
    """rtl where the first strong character of a text is written from right to left, else ltr."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        strong = lambda x: next((b for c in x if (b := unicodedata.bidirectional(c)) in ("L", "R", "AL")), "L")
        return s.map(lambda x: None if x is None else "ltr" if x.isascii() or strong(x) == "L" else "rtl")

    return run(text)


def display_size(width: Column, height: Column) -> Column:
    """Inches of pixels at 96 an inch, scaled down to 6.5 by 8."""
    w, h = width / 96.0, height / 96.0
    k = F.least(F.lit(1.0), 6.5 / w, 8.0 / h)
    return F.struct((w * k).alias("width_in"), (h * k).alias("height_in"))


def manifest_row(line: Column) -> Column:
    """The four numbers of a directory row, else null."""
    rx = r"^\s*\d{1,20}\s+\.[A-Za-z0-9]{1,8}\s+(\d{1,20})\s+(\d{1,20})\s+(\d{1,20})\s+(\d{1,20})\s*$"
    part = lambda k: F.regexp_extract(line, rx, k).cast("decimal(20,0)")
    return F.when(line.rlike(rx), F.struct(part(1).alias("at"), part(2).alias("size"), part(3).alias("preview_at"), part(4).alias("preview_size")))


def applies_to_page(kind: Column, page: Column) -> Column:
    """Whether furniture for all, odd, even or both kinds of pages stands on a page."""
    return kind.isin("all", "odd-even") | ((kind == "odd") & (page % 2 == 1)) | ((kind == "even") & (page % 2 == 0))


def fold_family(name: Column) -> Column:
    """Normalised key of a font family: NFKC, case folding, letters and digits only."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum()))

    return fold(name)


def lossiness(code: Column) -> Column:
    """What a diagnostic code loses: nothing, meaning, or content."""
    from ..parsing.model import CONTENT_LOSS, LOSSLESS

    return F.when(code.isin(*LOSSLESS), "none").when(code.isin(*CONTENT_LOSS) | code.startswith("wmf-"), "content").otherwise("semantic")
