"""SentencePiece encoding and decoding by streaming Viterbi.

A stream keeps a window of its text, and for each boundary in it the best score of a segmentation that ends there.
Only the last boundaries, as many as the longest piece has characters, can still be gone on from. Ids are committed,
and the window moves on, as soon as the backpointer paths of all of them go through one boundary: at once
where no piece spans a boundary, else found by walking the paths back. Every text goes this way: its words are streams
that run side by side (`Streams`), long texts are read by blocks, and memory beyond the text itself doesn't grow with it.

Scores: those of the model file if it is of unigram type. A file of BPE type has merge ranks in their place, which
don't add up as log probabilities; for it, a piece of rank r scores -ln(r + 1) (Zipf; unigram scores above 0 count as 0), so its ids are the best
segmentation over that vocabulary, which often differs from the merge order's; `merges=True` gives the latter,
exactly as the library does. Both decode to the same text.

Characters outside the vocabulary become byte pieces (or, in a model without them, the unknown id); a literal
U+2581 is written in bytes too, so that decoding is exact for every text.

Cases: a null text gives null ids, an empty one no ids; very long texts and words stream; equal rows give equal
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words remembered in a generation, and the longest of them; characters of a window, of all windows of a step, and of a
#: block that a long text is read by; characters of a step of words.
MEMO, LONG, WINDOW, SIDE, BLOCK, STEP = 100_000, 64, 512, 500_000, 65_536, 65_536
#: Stands for a literal U+2581 inside the encoder: a lone surrogate, which no text of a table holds.
LITERAL = "\udcff"
#: Scores are whole numbers of 1 / UNIT, so sums are exact and ties don't depend on where a window began: the longer
#: last piece wins.
UNIT = 1_000_000


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.path = path
        proto = ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.scores: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        ranked = proto.trainer_spec.model_type == 2
        rank = 0
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            out = b""
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unknown = i
                out = " ⁇ ".encode()
            elif p.type in (1, 4):
                rank += 1
                self.ids[p.piece] = i
                self.scores[p.piece] = -1 + round(UNIT * (-math.log(rank + 1) if ranked else min(0.0, p.score)))
                out = p.piece.replace(SPACE, " ").encode()
            self.text.append(out)
        self.longest = max(map(len, self.ids), default=1)
        self.outside = min(self.scores.values(), default=0) - 10 * UNIT  # the score of a character that is no piece
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        self.word_starts = not any(b == SPACE and a != SPACE for a, b in pairs)  # then nothing spans a word's start
        alone = "\n" if not any("\n" in x for x in pairs) else ""
        marks = set(".,;:!?")
        while bad := {b for a, b in pairs if b in marks and a not in marks and a != SPACE}:
            marks -= bad
        m = re.escape("".join(sorted(marks)))
        word = f"{SPACE}*[^{SPACE}{alone}{m}]+" + (f"|{SPACE}*[{m}][^{SPACE}{alone}]*" if marks else "")
        self.parts = re.compile(word + (f"|{alone}" if alone else "") + f"|{SPACE}+")

    @cached_property
    def library(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.path)

    @cached_property
    def streams(self) -> Streams:
        return Streams(self)

    def escape(self, text: str) -> str:
        return ((" " if self.dummy else "") + text.replace(SPACE, LITERAL)).replace(" ", SPACE)

    def spell(self, char: str) -> list[int]:
        raw = (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]


_M = np.uint64(0x9E3779B97F4A7C15)


def _narrow(keys: np.ndarray) -> np.ndarray:
    """Keys of 16 bits where they fit, which a stable sort takes in linear time."""
    return keys.astype(np.uint16) if len(keys) and keys.max() <= 0xFFFF else keys


class Streams:
    """Streaming Viterbi over many escaped texts at once, as array steps.

    A stream holds the window that starts at its last committed boundary. In a step all windows are searched for
    pieces (by 64-bit rolling hashes of at most `longest` characters), and all boundaries that lie equally far
    behind a point that no piece spans advance together. Paths that are still alive end in the window's last
    `longest` boundaries; ids up to the boundary where they all meet are committed, and the window moves there. A
    window in which they don't meet is doubled.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        scores: dict[str, int | None] = {p[:k]: None for p in v.ids for k in range(1, len(p) + 1)} | v.scores
        prefixes = sorted(scores)
        hashes = np.zeros(len(prefixes), np.uint64)
        for k, p in enumerate(prefixes):
            h = 0
            for c in p:
                h = (h * int(_M) + ord(c) + 1) & (2**64 - 1)
            hashes[k] = h
        self.bits = 17
        first = self._slot(hashes)
        order = np.lexsort((hashes, first))
        self.hashes = np.append(hashes[order], np.uint64(0))
        self.score = np.array([scores[prefixes[k]] or 0 for k in order] + [0], np.int64)
        self.piece = np.array([v.ids.get(prefixes[k], -1) for k in order] + [-1], np.int32)
        edges = np.searchsorted(first[order], np.arange((1 << self.bits) + 1))
        self.start = edges[:-1].astype(np.int32)
        self.size = np.diff(edges).astype(np.int8)
        self.deepest = int(self.size.max(initial=0))
        self.widest = 0  # the longest window so far

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for none."""
        slot = self._slot(h)
        at, left = self.start[slot], self.size[slot]
        out = np.full(len(h), -1, np.int32)
        rows = np.flatnonzero(left)
        for k in range(self.deepest):
            hit = self.hashes[at[rows] + k] == h[rows]
            out[rows[hit]] = at[rows[hit]] + k
            rows = rows[~hit]
            rows = rows[left[rows] > k + 1]
            if not len(rows):
                break
        return out

    def _pieces(self, chars: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first character, length, score, id) of every piece in the windows; a character that is no piece has the id -1."""
        total = len(chars)
        idx, h = np.arange(total), np.zeros(total, np.uint64)
        single = np.zeros(total, bool)
        froms, sizes, scores, ids = [], [], [], []
        for n in range(1, self.v.longest + 1):
            ok = idx + n <= limit[idx]
            idx, h = idx[ok], h[ok]
            h = h * _M + chars[idx + n - 1]
            at = self._find(h)
            ok = at >= 0
            idx, h, at = idx[ok], h[ok], at[ok]
            if not len(idx):
                break
            whole = self.piece[at] >= 0
            if n == 1:
                single[idx[whole]] = True
            froms.append(idx[whole]), sizes.append(np.full(len(froms[-1]), n)), scores.append(self.score[at[whole]]), ids.append(self.piece[at[whole]])
        rest = np.flatnonzero(~single)
        froms.append(rest), sizes.append(np.ones(len(rest), np.int64)), scores.append(np.full(len(rest), self.v.outside)), ids.append(np.full(len(rest), -1, np.int32))
        return tuple(map(np.concatenate, (froms, sizes, scores, ids)))

    def advance(self, windows: list[str], final: list[bool]) -> tuple[list[bytes], list[int]]:
        """For each window (none is empty) the ids that are committed, as bytes, and the characters they stand for: all of a final window."""
        self.widest = max(self.widest, *map(len, windows))
        count = len(windows)
        lens = np.fromiter(map(len, windows), np.int64, count)
        chars = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(lens)
        begin = ends - lens
        part = np.repeat(np.arange(count), lens)
        first, size, score, ids = self._pieces(chars, np.repeat(ends, lens))
        # boundaries: window k has its own from begin[k] + k to ends[k] + k
        a = first + part[first]
        b = a + size
        n = len(chars) + count
        wide = size > 1
        over = np.bincount(a[wide] + 1, minlength=n + 1) - np.bincount(b[wide], minlength=n + 1)  # pieces that span a boundary
        met = np.cumsum(over)[:n] == 0
        home, last = begin + np.arange(count), ends + np.arange(count)
        open_ends = [k for k, f in enumerate(final) if not f]
        for k in open_ends:  # what comes may span these
            met[max(home[k], last[k] - self.v.longest) + 1 : last[k] + 1] = False
        behind = np.arange(n) - np.maximum.accumulate(np.where(met, np.arange(n), 0))
        steps = behind[a]
        order = np.argsort(_narrow(steps), kind="stable")
        a, b, score, ids, steps = a[order], b[order], score[order], ids[order], steps[order]
        best, back, chosen = np.full(n, np.iinfo(np.int64).min // 2), np.zeros(n, np.int64), np.full(n, -1, np.int32)
        cuts = np.searchsorted(steps, np.arange(int(steps[-1]) + 2))
        for k in range(len(cuts) - 1):
            x = slice(cuts[k], cuts[k + 1])
            got = best[a[x]] + score[x] if k else score[x]
            better = got > best[b[x]]
            to = b[x][better]
            best[to], back[to], chosen[to] = got[better], a[x][better], ids[x][better]
        upto = last.copy()
        for k in open_ends:
            upto[k] = self._converged(back, int(home[k]), int(last[k]))
        return self._walk(windows, home, upto, back, chosen), (upto - home).tolist()

    def _converged(self, back: np.ndarray, home: int, last: int) -> int:
        """The last boundary that the paths of all live boundaries share."""
        live = set(range(max(home, last - self.v.longest + 1), last + 1))
        at = last
        while len(live) > 1:
            while at not in live:
                at -= 1
            live.remove(at)
            live.add(int(back[at]))
        return live.pop()

    def _walk(self, windows: list[str], home: np.ndarray, upto: np.ndarray, back: np.ndarray, chosen: np.ndarray) -> list[bytes]:
        """Ids of the paths back from upto, as bytes."""
        who, ids, at = [], [], []
        live = np.flatnonzero(upto > home)
        cur = upto[live]
        while len(live):
            who.append(live), ids.append(chosen[cur]), at.append(cur - 1 - home[live])
            cur = back[cur]
            more = cur > home[live]
            live, cur = live[more], cur[more]
        if not who:
            return [b""] * len(windows)
        w, i, c = (np.concatenate(x[::-1]) for x in (who, ids, at))  # last pieces first, so reversed
        order = np.argsort(_narrow(w), kind="stable")
        w, i, c = w[order], np.ascontiguousarray(i[order], np.int32), c[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(windows)))]).tolist()
        flat = i.tobytes()
        out = [flat[4 * x : 4 * y] for x, y in zip(edges, edges[1:])]
        for k in set(w[i < 0].tolist()):
            mine = array("i")
            for x in range(edges[k], edges[k + 1]):
                mine.extend((int(i[x]),) if i[x] >= 0 else self.v.spell(windows[k][c[x]]))
            out[k] = mine.tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes: all are streams that run side by side."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if len(texts) and 0 < lens.min() and lens.max() <= WINDOW:  # words: a window each, and no stream goes on
            edges = [*np.flatnonzero(np.diff(np.cumsum(lens) // STEP, prepend=-1)).tolist(), len(texts)]
            return [ids for x, y in zip(edges, edges[1:]) for ids in self.advance(texts[x:y], [True] * (y - x))[0]]
        out: list[list[bytes]] = [[] for _ in texts]
        at, width = [0] * len(texts), [WINDOW] * len(texts)
        live = [k for k, t in enumerate(texts) if t]
        while live:
            some, chars = [], 0
            while live and chars < SIDE:
                some.append(live.pop())
                chars += min(width[some[-1]], len(texts[some[-1]]))
            final = [at[k] + width[k] >= len(texts[k]) for k in some]
            got = self.advance([texts[k][at[k] : at[k] + width[k]] for k in some], final)
            for k, ids, n, end in zip(some, *got, final):
                out[k].append(ids)
                if not end:
                    at[k] += n
                    width[k] = WINDOW if n else 2 * width[k]
                    live.append(k)
        return [b"".join(x) for x in out]


class Stream:
    """One stream that is fed piecemeal. push() and finish() return committed ids."""

    def __init__(self, v: Vocabulary):
        self.streams, self.window = v.streams, ""

    def push(self, text: str) -> list[int]:
        self.window += text
        if len(self.window) < 2 * self.streams.v.longest:
            return []
        (ids,), (n,) = self.streams.advance([self.window], [False])
        self.window = self.window[n:]
        return array("i", ids).tolist()

    def finish(self) -> list[int]:
        ids, self.window = self.streams.advance([self.window], [True])[0][0] if self.window else b"", ""
        return array("i", ids).tolist()


class Encoder:
    """Encodes whole texts. Where no piece of the vocabulary spans a word's start every path converges there, so a
    word is committed at its end, and the ids of committed words are remembered (two generations of MEMO words)."""

    def __init__(self, path: str = MODEL, merges: bool = False):
        self.v = Vocabulary(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merges = merges
        self.streams = self.v.streams

    def _blocks(self, text: str):
        """The words of a text, a block of about BLOCK characters at a time."""
        at, size = 0, BLOCK
        while at < len(text):
            words = self.v.parts.findall(text[at : at + size])
            if at + size < len(text):
                if len(words) == 1:
                    size *= 2
                    continue
                words.pop()  # it may go on
            yield words
            at, size = at + sum(map(len, words)), BLOCK

    def _words(self, blocks: list[list[str]]) -> list[bytes]:
        """The ids of each list of words; words new to the memo run through the streams together."""
        memo = self.memo
        new = set().union(*blocks).difference(memo)
        kept = new.intersection(self.older)  # what is still in use moves on
        memo.update({p: self.older[p] for p in kept})
        fresh = list(new - kept)
        memo.update(zip(fresh, self.streams.encode(fresh)))
        out = [b"".join(map(memo.__getitem__, ps)) for ps in blocks]
        for p in fresh:
            if len(p) > LONG:
                del memo[p]
        if len(memo) >= MEMO:
            self.older, self.memo = memo, {}
        return out

    def encode_many(self, texts: list[str | None]) -> list[array | None]:
        """Ids of each text."""
        out = [None if t is None else array("i") for t in texts]
        short, blocks = [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.merges:
                out[k].extend(self.v.library.encode(t))  # the library's own merge order
                continue
            t = self.v.escape(t)
            if not self.v.word_starts:
                out[k].frombytes(self.streams.encode([t])[0])
            elif len(t) <= BLOCK:
                short.append(k), blocks.append(self.v.parts.findall(t))
            else:
                for words in self._blocks(t):
                    out[k].frombytes(self._words([words])[0])
        for k, ids in zip(short, self._words(blocks) if blocks else ()):
            out[k].frombytes(ids)
        return out

    def encode(self, text: str) -> array:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.v.text.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.v.dummy and raw[:1] == " " else raw


_encoders: dict[tuple, Encoder] = {}


def encoder(model: str = MODEL, merges: bool = False) -> Encoder:
    """The encoder that this process keeps for a model file as it is now, with its remembered words: a worker runs many tasks."""
    now = os.stat(model)
    key = (model, merges, now.st_mtime_ns, now.st_size)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, merges)
    return _encoders[key]


def encode_documents(docs: DataFrame, model: str = MODEL, merges: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_crc32 (of the text that the ids decode to), lossless."""

    def run(batches):
        enc = encoder(model, merges)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                values, offsets, counts, crc, same = array("i"), array("i", [0]), [], [], []
                texts = b.column(1).to_pylist()
                for t, ids in zip(texts, enc.encode_many(texts)):
                    if ids is None:
                        counts.append(None), crc.append(None), same.append(None)
                    else:
                        back = enc.decode(ids)
                        counts.append(len(ids)), crc.append(zlib.crc32(back.encode("utf-8", "surrogatepass"))), same.append(back == t)
                        values.frombytes(ids.tobytes())
                    offsets.append(len(values))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=pa.array([t is None for t in texts]) if None in texts else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), lists, pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded_crc32", "lossless"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, decoded_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches):
        enc = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
