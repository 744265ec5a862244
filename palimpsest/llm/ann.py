"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are normalised, so the largest cosine is the largest inner product. The quantiser minimises
|r|^2 + (eta - 1) * (r . x)^2 for the residual r of a unit vector x: the part of the error that is parallel to x,
which is what distorts high scores, weighs eta > 1 times the rest. Every two dimensions share a codebook of 16
centroids, so a code has four bits. Codebooks are trained by alternating coordinate descent over codes with
closed-form centroid updates, on a bounded sample (SAMPLE rows with the smallest seeded hashes); every row is
indexed. A search scans the packed codes with integer lookup tables, two codes a byte, and the best RERANK vectors of
every block are scored again on the original vectors in double precision. Equal vectors are one candidate with all
their ids, so copies push nothing out, and every vector whose quantised score equals the last of the best is scored
again too, so the order of the rows decides nothing. The index also holds the cosine of each vector and its
reconstruction; with the quantised score it bounds the true score (angles obey the triangle inequality), and each
vector whose bound reaches the k-th best found so far is scored again as well. So codes only exclude what can't be
among the k best: tight clusters, or vectors that share a large common part, cost more time and lose no neighbour.

The query set is compared with all rows in blocks of (query group x row block), so no task holds more than one of
each, and a block returns k rows a query.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different
lengths have no cosine, so each length is a search of its own; equal scores go to the smaller id; rows of one id are
never each other's neighbours, equal query rows are one query, and different vectors of one id are queries of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sample, table

SUB, CENTROIDS, SAMPLE, ETA, RERANK = 2, 16, 20000, 2.6, 128
ROWS, QUERIES, SEED, SAMPLE_COMPONENTS = 16384, 8192, 7, 8_000_000
FEW = 512  # more candidates than these are scored by one matrix product first


def _split(x: np.ndarray) -> np.ndarray:
    """rows x subspaces x SUB, padded with zeros."""
    pad = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)


def assign(x: np.ndarray, books: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes of unit vectors x (rows x subspaces x SUB) by coordinate descent on the anisotropic loss."""
    return np.concatenate([_assign(x[k : k + 1024], books, eta, sweeps) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(x.shape[:2], np.int64)


def _assign(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    n, m, _ = x.shape
    d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)  # rows x subspaces x 16
    par = ((x[:, :, None, :] - books[None]) * x[:, :, None, :]).sum(3)
    codes = d.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(par, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - par[rows, j, codes[:, j]]
            loss = d[:, j] + (eta - 1) * (rest[:, None] + par[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            total = rest + par[rows, j, codes[:, j]]
    return codes


def train(x: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Codebooks (subspaces x 16 x SUB) from unit vectors."""
    rng = np.random.default_rng(seed)
    x = _split(x)
    n, m, s = x.shape
    books = x[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)].transpose(1, 0, 2).copy()
    for r in range(rounds):
        codes = assign(x, books, 1.0 if r < 3 else eta, 0 if r < 3 else 1)
        e = 1.0 if r < 3 else eta
        par = ((x - books[np.arange(m)[None], codes]) * x).sum(2)
        total = par.sum(1)
        for j in range(m):
            rest = total - par[:, j]
            xj = x[:, j]
            a = np.zeros((CENTROIDS, s, s))
            b = np.zeros((CENTROIDS, s))
            np.add.at(a, codes[:, j], np.eye(s)[None] + (e - 1) * xj[:, :, None] * xj[:, None, :])
            np.add.at(b, codes[:, j], xj * (1 + (e - 1) * (rest + (xj * xj).sum(1)))[:, None])
            used = np.bincount(codes[:, j], minlength=CENTROIDS) > 0
            books[j, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            par[:, j] = ((xj - books[j, codes[:, j]]) * xj).sum(1)
            total = rest + par[:, j]
    return books


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Packed codes: rows x bytes, two subspaces a byte."""
    codes = assign(_split(x), books).astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def _unpack(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes, rows x subspaces."""
    return np.stack((packed & 15, packed >> 4), 2).reshape(len(packed), -1)[:, : len(books)]


def lengths(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Lengths of the reconstructed vectors."""
    return np.sqrt((books**2).sum(2)[np.arange(len(books)), _unpack(packed, books)].sum(1))


def fidelity(x: np.ndarray, packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Cosine of each unit vector and its reconstruction, 0 where that has no length."""
    dot = (_split(x) * books[np.arange(len(books)), _unpack(packed, books)]).sum((1, 2))
    size = lengths(packed, books)
    return np.clip(dot / np.where(size > 0, size, 1), -1, 1)


def tables(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables of the queries, queries x bytes x 256, as 16-bit integers, and what 1 stands for in each query's."""
    t = np.einsum("qms,mcs->qmc", _split(q), books)
    if t.shape[1] % 2:
        t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
    lut = t[:, 0::2, None, :] + t[:, 1::2, :, None]  # high code first: byte = low | high << 4
    lut = lut.reshape(len(q), lut.shape[1], 256)
    scale = np.abs(lut).max((1, 2), keepdims=True) * lut.shape[1]
    scale = np.where(scale > 0, scale, 1)
    return np.round(lut / scale * 32000).astype(np.int16), scale[:, 0, 0] / 32000


def collapse(x: np.ndarray, xid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of x by vector, inside a vector by id: (order of the rows, where each vector starts and the end, first
    row of each vector). Vectors are equal if their components are: -0.0 is 0.0."""
    raw = np.ascontiguousarray(x + 0.0)
    _, group = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1])))[:, 0], return_inverse=True)
    order = np.lexsort((xid, group))
    start = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(x))
    return order, start, order[start[:-1]]


def search_block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int, fit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best per query in one block. q, x: original vectors; fit: their fidelity,
    without which only the best by quantised score are scored again."""
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    member, start, one = collapse(x, xid)
    ids, size = xid[member], np.diff(start)
    x = x[one]
    norms = np.linalg.norm(x, axis=1)
    by_byte = np.ascontiguousarray(codes[one].T)
    if fit is not None:
        fit, made = fit[one], lengths(codes[one], books)
        off, known = np.sqrt(1 - fit**2), made > 0
        made = np.where(known, made, 1)
        first, last = ids[start[:-1]], ids[start[1:] - 1]
    out = ([], [], [])
    for lo in range(0, len(q), 64):
        lut, worth = tables(unit[lo : lo + 64], books)
        cosines = None
        for i in range(len(lut)):
            score = lut[i, 0].take(by_byte[0])
            for b in range(1, len(by_byte)):
                score += lut[i, b].take(by_byte[b])
            r = rerank + 1  # one may be the query itself
            best = np.flatnonzero(score >= np.partition(score, len(score) - r)[len(score) - r]) if len(score) > r else np.arange(len(score))
            v = q[lo + i]
            length = np.sqrt((v * v).sum())
            exact = (x[best] * v).sum(1) / (norms[best] * length)
            if fit is not None and len(best) < len(score):
                others = (first != qid[lo + i]) | (last != qid[lo + i])  # vectors that aren't the query's id alone
                found = exact[others[best]]
                least = np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else -2.0
                a = np.clip((score + len(by_byte) / 2) * worth[i] / made, -1, 1)  # each looked-up value is rounded
                bound = np.where((a >= fit) | ~known, 1.0, a * fit + np.sqrt(1 - a * a) * off)
                bound[best] = -3
                more = np.flatnonzero(bound >= least - 1e-7)
                if len(more) > FEW:
                    if cosines is None:
                        cosines = (unit[lo : lo + 64] @ x.T) / norms
                    c = cosines[i, more]
                    sure = c[others[more]]
                    if len(sure) >= k:
                        least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
                    more = more[c >= least - 1e-9]
                best, exact = np.append(best, more), np.append(exact, (x[more] * v).sum(1) / (norms[more] * length))
            if (size[best] == 1).all():
                rows, scores = start[best], exact
            else:  # of each vector the k smallest ids that aren't the query's
                take = []
                for g in best:
                    a, z = start[g], start[g + 1]
                    l, h = a + np.searchsorted(ids[a:z], qid[lo + i], "left"), a + np.searchsorted(ids[a:z], qid[lo + i], "right")
                    take.append(np.concatenate([np.arange(a, min(l, a + k)), np.arange(h, min(z, h + max(0, k - (l - a))))]))
                rows, scores = np.concatenate(take), np.repeat(exact, [len(t) for t in take])
            other = ids[rows] != qid[lo + i]
            rows, scores = rows[other], scores[other]
            order = np.lexsort((ids[rows], -scores))[:k]
            out[0].append(np.full(len(order), lo + i))
            out[1].append(member[rows[order]])
            out[2].append(scores[order])
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def valid(vectors: DataFrame) -> DataFrame:
    """id, v (array<double>), d (its length) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(v, c -> c <> 0)")
    return ok.withColumn("d", F.size("v"))


def search(vectors: DataFrame, is_query, k: int = 5, rerank: int = RERANK, train_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the column id."""
    base = valid(vectors)
    lengths = [r["d"] for r in base.where(is_query).select("d").distinct().collect()]  # as a rule one; a search each
    found = [_search(base.where(F.col("d") == d), d, is_query, k, rerank, train_rows) for d in sorted(lengths)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionByName, found)


def _search(base: DataFrame, d: int, is_query, k: int, rerank: int, train_rows: int) -> DataFrame:
    schema = "query_id long, query long, vec_id long, score double"
    # the sample is bounded in bytes, too
    some = sample(base, "id", max(256, min(train_rows, SAMPLE_COMPONENTS // d)), SEED).toPandas()
    x = np.array(some["v"].tolist())
    books = train(x / np.linalg.norm(x, axis=1, keepdims=True))

    def index(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a = np.array(b.column(1).to_pylist())
            unit = a / np.linalg.norm(a, axis=1, keepdims=True)
            packed = encode(unit, books)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(fidelity(unit, packed, books)), pa.array([r.tobytes() for r in a], pa.binary())], ["id", "code", "fit", "v"])

    indexed = cut(base.select("id", "v").mapInArrow(index, "id long, code binary, fit double, v binary"))
    n = indexed.count()
    n_queries = indexed.where(is_query).count()
    blocks, groups = -(-n // ROWS), max(1, -(-n_queries // QUERIES))
    h = F.xxhash64("id")
    left = indexed.withColumn("block", F.pmod(h, F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = indexed.where(is_query).dropDuplicates(["id", "v"]).select("id", "v", F.xxhash64("v").alias("query"), F.pmod(h, F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def score(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        mat = lambda s: np.frombuffer(b"".join(s), np.float64).reshape(len(s), -1)
        q, x = mat(queries["v"]), mat(rows["v"])
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        qid, xid = queries["id"].to_numpy(), rows["id"].to_numpy()
        a, b, s = search_block(q, qid, x, xid, codes, books, k, rerank, rows["fit"].to_numpy())
        return pd.DataFrame({"query_id": qid[a], "query": queries["query"].to_numpy()[a], "vec_id": xid[b], "score": s})

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(score, schema)
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")  # at most k rows a block
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
