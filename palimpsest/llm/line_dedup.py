"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of every WINDOW = 2 neighbouring lines with words. A chunk is a longest stretch of lines
whose rolling hashes all occur in an earlier place of the corpus (smallest doc_id, then row hash and line number): its
boundaries lie where the content stops being repeated, so they move with the text and an inserted line only disturbs
the chunk around it. Chunks have two lines at least; hashes propose them, and they go after the bytes of each pair of
lines, blank lines between the two included, are compared with those of its first place. So every repeated run of
two or more lines goes, whatever its length and wherever it lies, and the first occurrence of a line in the corpus
always stays. Lines of a pair that overlaps its own first place (a line three times in a row) leave that place
whole. A line that goes takes the blank lines after it along.

(Boundaries where a rolling hash is divisible by a constant were tried first: of 125 shared runs of two or more
lines with over 50 words in sf0.1, 116 held no whole chunk and stayed.)

Cases: null text stays null and empty text empty; a text of one line is never touched; of equal documents the
first keeps its text; rows with one doc_id are told apart by their content only, so equal rows are cleaned alike;
an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, fresh, per_batch, table

BROADCAST = 1_000_000
SPACES = " \t\n\x0b\x0c\r"
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of each line with words, without the line break."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _pair(text: str, at: list[tuple[int, int]], k: int) -> bytes:
    return text[at[k][0] : at[k + 1][1]].encode("utf-8", "surrogatepass")


def rolling(text: str) -> list[int]:
    """The hash of each pair of neighbouring lines, and of the blank lines between the two, from the hashes of the lines."""
    out, last, blank, n = [], 0, 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
            if n:
                out.append(((last * _ODD + blank) * _ODD + h) & _MASK)
            last, blank, n = h, 0, n + 1
        else:
            blank = (blank * _ODD + len(line) + 1) & _MASK
    return [h - (1 << 64) if h >> 63 else h for h in out]


def _pairs(batch: pa.RecordBatch):
    docs, rows, nos, hashes = [], [], [], []
    for d, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
        mine = rolling(t or "")
        docs += [d] * len(mine)
        rows += [r] * len(mine)
        nos += range(len(mine))
        hashes += mine
    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(nos, pa.int32()), pa.array(hashes, pa.int64())], ["doc_id", "row", "no", "h"])


def _pair_texts(batch: pa.RecordBatch):
    """The texts of the wanted pairs. Columns: doc_id, row, text, nos."""
    docs, rows, out, texts = [], [], [], []
    for d, r, t, nos in zip(*(batch.column(i).to_pylist() for i in range(4))):
        at = lines(t or "")
        for k in nos:
            if k + 1 < len(at):
                docs.append(d)
                rows.append(r)
                out.append(k)
                texts.append(_pair(t, at, k))
    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(out, pa.int32()), pa.array(texts, pa.binary())], ["doc_id", "row", "no", "piece"])


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), nos: numbers of the lines that go."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    place = F.struct("doc_id", "row", "no")
    pairs = cut(per_batch(texts, _pairs, "doc_id long, row long, no int, h long"))
    repeated = pairs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    wanted = cut(attach(pairs, repeated, ["h"], "n", place).where("n is not null").select("doc_id", "row", "no"))
    by_doc = wanted.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("no")).alias("nos"))  # at most a document's own lines
    if wanted.count() <= BROADCAST:
        by_doc = F.broadcast(by_doc)
    pieces = cut(per_batch(texts.join(by_doc, ["doc_id", "row"]).select("doc_id", "row", "text", "nos"), _pair_texts, "doc_id long, row long, no int, piece binary"))
    first = pieces.groupBy("piece").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")  # the comparison of bytes
    digest = F.sha2("piece", 256).alias("digest")  # from here on a pair of lines, however long, travels as this
    again = attach(pieces.select(digest, "doc_id", "row", "no"), cut(first.select(digest, "first", "n")), ["digest"], "n", place).where(F.col("first").isNotNull() & (place != F.col("first")))
    overlaps = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("no") == F.col("first.no") + 1)
    gone = again.select("doc_id", "row", F.explode(F.when(overlaps, F.array(F.col("no") + 1)).otherwise(F.array(F.col("no"), F.col("no") + 1))).alias("no"))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("no")).alias("nos"))


def _without_lines(t: str, nos: list[int]) -> tuple[str, int]:
    """The text without these lines, and how many runs they make."""
    drop, starts = set(nos), [a for a, _ in lines(t)] + [len(t)]
    new = t[: starts[0]] + "".join(t[a:b] for k, (a, b) in enumerate(zip(starts, starts[1:])) if k not in drop)
    return new if t.endswith("\n") else new.rstrip("\n"), sum(k - 1 not in drop for k in drop)


def _cleaner(names: list[str], removed: str, chars: str):
    at = names.index("text")

    def fn(batch: pa.RecordBatch):
        texts, gone, cut_chars = [], [], []
        for t, nos in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
            n = k = 0
            if t and nos:
                new, k = _without_lines(t, nos)
                n = len(t) - len(new)
                t = new
            texts.append(t)
            gone.append(k)
            cut_chars.append(n)
        arrays = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone, pa.int32()), pa.array(cut_chars, pa.int64())], [*names, removed, chars])

    return fn


def clean(docs: DataFrame) -> DataFrame:
    """docs without the repeated chunks, with their columns; n_chars, if there is one, follows the text. Adds
    _removed (chunks) and _chars (characters taken away), with more underscores where docs has such columns."""
    key, row, nos, removed, chars = fresh(docs, "_id", "_row", "_nos", "_removed", "_chars")
    gone = cut(removals(docs).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("nos").alias(nos)))
    if gone.agg(F.coalesce(F.sum(F.size(nos)), F.lit(0))).first()[0] <= BROADCAST:
        gone = F.broadcast(gone)
    j = docs.join(gone, (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(row)), "left")
    names = docs.columns
    out = per_batch(j.select(*[F.col(f"`{c}`") for c in names], nos), _cleaner(names, removed, chars), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {removed} int, {chars} long")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_removed").alias("n_removed_chunks"), F.col("_chars").alias("n_removed_chars"), "text")
