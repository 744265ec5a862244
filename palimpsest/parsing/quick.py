"""The tables of a document in the plain form that most table documents have, by one regular expression: one table frame, cells
of whole numbers with a word or none, a body of nothing but its anchor. Anything else is for the parser (None); what is read
here is what the parser reads."""

from __future__ import annotations

import re
from functools import lru_cache

from . import records
from .document import parse
from .envelope import Rejected

MOST = 1 << 16  # bytes; no limit of a document can be reached below
_N = r"\d{1,9}"
_WORD = r"(?:<\+[@ABC]>)?[A-Za-z][A-Za-z0-9]*"
_CELL = rf"\t\t\t({_N} {_N}(?: {_N}){{10}})\r\n(?:\t\t\t({_WORD})\r\n)?\t\t\t>\r\n"
_FORM = re.compile(
    rf"\[frm\]\r\n\t{_N}\r\n\t{_N}\r\n\t(-?{_N})\r\n\t(-?{_N})\r\n\t(-?{_N})\r\n\t(-?{_N})\r\n\t\[tbl\]\r\n\t\t({_N}(?: {_N}){{8}})\r\n"
    rf"(?:\t\t\[h\]\r\n((?:\t\t\t{_N}(?: {_N}){{6}}\r\n)*))?(?:\t\t\[w\]\r\n((?:\t\t\t{_N}(?: {_N}){{4}}\r\n)*))?"
    rf"\t\[data\]\r\n((?:{_CELL.replace('(' + _N, '(?:' + _N, 1).replace('(' + _WORD, '(?:' + _WORD, 1)})+)\t\[e\]\r\n\[edoc\]\r\n<:t0>\r\n>\r\n".encode()
)
_EACH = re.compile(_CELL.encode())
_ALIGN = {ord(k): [v] for k, v in records._CELL_ALIGN.items()}


class Tables:
    """As much of a Document as the relations of tables need."""

    __slots__ = ("tables",)

    def __init__(self, tables: list[dict]):
        self.tables = tables


class _Place:
    __slots__ = ("fields", "text", "rows", "cols")

    def __init__(self, fields: list[int], text: str):
        self.fields, self.text, self.rows, self.cols = fields, text, 1, 1


@lru_cache(256)
def _plain(head: bytes) -> bool:
    """Whether what stands before the frame is a Western document's header without frames, that parses."""
    low = head.lower()
    if not head.isascii() or b"[edoc]" in low or b"[frm]" in low or b"[embedded]" in low or not head.endswith(b"\r\n") or len(head.decode("latin-1").splitlines()) != head.count(b"\n"):
        return False
    try:
        return parse(head + b"[edoc]\r\n>\r\n").encoding == "cp1252"
    except Rejected:
        return False


@lru_cache(4096)
def _numbers(text: bytes) -> list[int]:
    return list(map(int, text.split()))


def tables(data: bytes) -> Tables | None:
    at = data.find(b"[frm]\r\n")
    if at < 0 or len(data) > MOST or not (m := _FORM.fullmatch(data, at)) or not _plain(data[:at]):
        return None
    left, top, right, bottom, stated, rows, columns, content = m.groups()
    d = _numbers(stated)
    n_rows, n_cols = d[0], d[1]
    if not (1 <= n_rows <= 4000 and 1 <= n_cols <= 256 and n_rows * n_cols <= 100_000 and max(d[2:6]) <= 32767):
        return None
    shapes: list[list] = [["tbl", 9, d, True]]
    by: list[dict[int, list[int]]] = []
    for family, n, part, most in (("h", 7, rows, n_rows), ("w", 5, columns, n_cols)):
        by.append(seen := {})
        for x in part.splitlines() if part else ():
            v = _numbers(x)
            good = v[0] not in seen and v[0] < most and v[1] <= 32767 and v[2] <= 32767
            if good:
                seen[v[0]] = v
            shapes.append([family, n, v, good])
    log: list[dict] = []
    places: dict[tuple[int, int], _Place] = {}
    owner: dict[tuple[int, int], int] = {}
    joined = False
    for numbers, word in _EACH.findall(content):
        v = list(map(int, numbers.split()))
        place = (v[0], v[1])
        if v[0] >= n_rows or v[1] >= n_cols:
            return None
        alignments = []
        if word[:1] == b"<":
            alignments, word = _ALIGN[word[2]], word[4:]
        text = word.decode()
        joined = joined or v[2] & 384 != 0
        if place in places:
            places[place].text += records.DUPLICATE
        else:
            places[place] = _Place(v, text)
            owner[place] = len(log)
        log.append({"place": place, "fields": v, "text": text, "raw_empty": not text, "ordinal": len(log), "alignments": alignments, "material": len(text), "after": 0, "span": (1, 1), "covered": False})
    if joined:
        covered, _ = records.merge(places, n_rows, n_cols)
        for c in log:
            p = places[c["place"]]
            if owner[c["place"]] == c["ordinal"]:
                c["span"] = (p.rows, p.cols)
            c["covered"] = c["place"] in covered
    info = {"frame": 0, "line": data.count(b"\n", 0, at), "definition": d, "rows": list(by[0].values()), "columns": list(by[1].values()), "cells": log, "shapes": shapes, "formulas": 0, "bounds": [int(left), int(top), int(right), int(bottom)]}
    return Tables([info])
