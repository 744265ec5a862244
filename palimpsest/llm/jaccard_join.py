"""N-gram Jaccard join with a count-vector R-tree.

Two documents link when 100 * |A and B| >= 70 * |A or B| for their sets of 3-word shingles (64-bit hashes).

1. Equal sets collapse to classes (128-bit set hash and size), so copies are never paired.
2. A class can only link if at least 70 % of its shingles occur in another class. One pass sends each shingle
   hash to a part, packed: a worker sums what it sees first, so a shingle sends at most one entry a payload
   however many documents have it. Most documents end here.
3. Of the rest, the rarest shingles that a link must touch (prefix filter in order of document frequency) tie
   classes into candidate families. Frequencies are asked for and told in the same packed way. No pairs are made: every class is tied to the smallest of a shingle's.
4. In a family, shingles are hashed into GROUPS groups; the group counts of a class are a point. Points are bulk
   loaded into an R-tree (leaves by size, then by the widest coordinate). The overlap of two points, or of two
   boxes, is at most the sum of their coordinate minima; where that is under what a link needs, the pair of
   leaves or points is dropped. What is left is verified on the shingle sets.
   A family over TILE members becomes an R-tree over many tasks: its members, in order of size class and first
   occupied coordinate, are cut into tiles of at most TILE members and about TILE_HASHES shingles, and only pairs of tiles whose boxes
   (over FINE groups) can hold a link are joined, each in a task of its own.
   The sets go to families and tiles in one shuffle; only those of large families are sent again.
5. Links are summed per class, weighted by the copies of the partner; components come from star contraction.

Results are exact up to collisions of 64-bit hashes; nothing is capped or sampled.

Cases: null, empty and wordless texts have no shingles, link with nothing and are their own component; a text of
one or two words is one shingle; very long texts are read whole; repeated rows are separate documents, as are rows of
one doc_id with different texts (component by doc_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, cut, fresh, per_batch, release, running, small_batches, table

GROUPS, FINE, LEAF, TILE, TILE_HASHES, MEMO, BROADCAST, MANY = 64, 4096, 32, 1024, 2_000_000, 150_000, 1_000_000, 0xFFFF
#: Shingles of a payload and of a part, from a small corpus to a large one, and the number of parts from which parts grow.
FLUSH, PART, PARTS = (1_000_000, 8_000_000), (1_500_000, 16_000_000), 20_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_S = [np.uint64(s) for s in (30, 27, 31)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _K[3]
    x = (x ^ (x >> _S[1])) * _K[4]
    return x ^ (x >> _S[2])


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    get, new = memo.get, xxhash.xxh64_intdigest
    hashes = array("Q", bytes(8 * len(words)))
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = new(w)
            if len(w) < 64:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = h
        hashes[i] = h
    a = np.frombuffer(hashes, np.uint64)
    if len(a) < 3:
        a = np.pad(a, (0, 3 - len(a)), constant_values=len(a))
    return np.unique(mix(a[:-2] * _K[0] + mix(a[1:-1]) * _K[1] + mix(a[2:] + _K[0]) * _K[2]))


def signature(h: np.ndarray) -> tuple[int, int]:
    return int(mix(h + _K[1]).sum(dtype=np.uint64).view(np.int64)), int(mix(h ^ _K[2]).sum(dtype=np.uint64).view(np.int64))


def need(a, b):
    """Least overlap of a link between sets of these sizes."""
    return -(-70 * (np.asarray(a, np.int64) + np.asarray(b, np.int64)) // 170)


# --- shingles that another class has -------------------------------------------------------------------------


def shape(hashes: int) -> tuple[int, int]:
    """(parts, shingles of a payload) for a corpus of so many shingles: parts have a bounded size at every volume, and payloads
    grow with them so that a row still carries several shingles."""
    size = min(PART[1], max(PART[0], hashes // PARTS))
    parts = max(4, hashes // size)
    return parts, min(FLUSH[1], max(FLUSH[0], 8 * parts))


def _spread(key: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes: a part is a range of them, inside which the lower 32 bits tell them apart."""
    part = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
    return [(int(part[a]), a, b) for a, b in zip(edges, edges[1:])]


def _payloads(parts: int, flush: int):
    """Rows (part, pid, blob). part >= 0: hashes of that part, one entry each; part < 0: a payload's own table."""

    def pack(pid: int, ids, sets: list[np.ndarray], sigs):
        first: dict[tuple[int, int], int] = {}
        rows = [first.setdefault(s, len(first)) for s in sigs]  # copies share an entry
        keep = {r: i for i, r in reversed(list(enumerate(rows)))}
        own = [sets[keep[r]] for r in range(len(first))]
        h = np.concatenate(own) if own else np.zeros(0, np.uint64)
        e = np.repeat(np.arange(len(own), dtype=np.uint32), [len(x) for x in own])
        order = np.argsort(h, kind="stable")
        h, e = h[order], e[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        size = np.diff(np.append(start, len(h)))
        local = np.bincount(e[np.repeat(size > 1, size)], minlength=len(own)).astype(np.uint32)
        key, entry = h[start], np.where(size > 1, MANY, e[start]).astype(np.uint16)
        low = key.astype(np.uint32)
        out = [(part, pid, low[a:b].tobytes() + entry[a:b].tobytes()) for part, a, b in _spread(key, parts)]
        sig = np.array(sigs, np.int64).reshape(-1, 2)
        n = np.array([len(x) for x in sets], np.int64)
        body = np.array([len(sets), len(own)], np.uint32).tobytes() + np.array(ids, np.int64).tobytes() + np.ascontiguousarray(sig).tobytes() + n.tobytes() + np.array(rows, np.uint32).tobytes() + local.tobytes()
        out.append((-1 - pid % parts, pid, body))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["part", "pid", "blob"])

    def run(batches):
        memo: dict[bytes, int] = {}
        pid, total = TaskContext.get().partitionId() << 24, 0
        ids, sets, sigs = [], [], []
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    h = shingles(t, memo)
                    ids.append(d), sets.append(h), sigs.append(signature(h))
                    total += len(h)
                if total >= flush or len(ids) > MANY - 512:
                    yield pack(pid, ids, sets, sigs)
                    pid, total, ids, sets, sigs = pid + 1, 0, [], [], []
        if ids:
            yield pack(pid, ids, sets, sigs)

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For each payload's entries, the number of hashes of this part that another class has too."""
    if rows["part"].iloc[0] < 0:
        return pd.DataFrame({"pid": rows["pid"], "own": True, "blob": rows["blob"]})
    low, entry, src = [], [], []
    for k, blob in enumerate(rows["blob"]):
        n = len(blob) // 6
        low.append(np.frombuffer(blob, np.uint32, n))
        entry.append(np.frombuffer(blob, np.uint16, n, 4 * n))
        src.append(np.full(n, k, np.uint32))
    low, entry, src = map(np.concatenate, (low, entry, src))
    order = np.argsort(low, kind="stable")
    low, entry, src = low[order], entry[order], src[order]
    many = entry == MANY
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(start, len(low)))
    # in two payloads, or in two classes of one: taken as shared (copies in two payloads are, too, which only
    # leaves more classes for the next step)
    shared = np.repeat((size > 1) | np.logical_or.reduceat(many, start), size) & ~many
    src, entry = src[shared], entry[shared]
    out = []
    order = np.argsort(src, kind="stable")
    src, entry = src[order], entry[order]
    at = np.searchsorted(src, np.arange(len(rows) + 1))
    for k in range(len(rows)):
        if at[k + 1] > at[k]:
            e, c = np.unique(entry[at[k] : at[k + 1]], return_counts=True)
            times = (c + 254) // 255  # a count that a byte can't hold is told in several
            told = np.full(times.sum(), 255)
            told[np.cumsum(times) - 1] = c - 255 * (times - 1)
            out.append((rows["pid"].iloc[k], False, np.repeat(e, times).astype(np.uint16).tobytes() + told.astype(np.uint8).tobytes()))
    return pd.DataFrame(out, columns=["pid", "own", "blob"])


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Per document of a payload: doc_id, n, s1, s2, shared."""
    body = rows.loc[rows["own"], "blob"].iloc[0]
    n, m = (int(x) for x in np.frombuffer(body, np.uint32, 2))
    at = 8
    ids = np.frombuffer(body, np.int64, n, at)
    sig = np.frombuffer(body, np.int64, 2 * n, at + 8 * n).reshape(-1, 2)
    size = np.frombuffer(body, np.int64, n, at + 24 * n)
    entry = np.frombuffer(body, np.uint32, n, at + 32 * n)
    total = np.frombuffer(body, np.uint32, m, at + 36 * n).astype(np.int64)
    for blob in rows.loc[~rows["own"], "blob"]:
        k = len(blob) // 3
        np.add.at(total, np.frombuffer(blob, np.uint16, k), np.frombuffer(blob, np.uint8, k, 2 * k).astype(np.int64))
    return pd.DataFrame({"doc_id": ids, "n": size, "s1": sig[:, 0], "s2": sig[:, 1], "shared": total[entry]})


# --- the prefix filter -----------------------------------------------------------------------------------------


def _asked(parts: int, flush: int):
    """Rows (part, pid, blob) from cls, hashes: each hash of a part once a payload, with the classes there that have it. With
    no parts, a payload's own classes and sets as part -1; both passes read the same stored partitions, so payloads agree;
    a payload's name is its first class."""

    def pack(pid: int, cls: list[int], sets: list[bytes]):
        if not parts:
            return batch([(-1, pid, np.array([len(cls), *cls, *[len(x) // 8 for x in sets]], np.int64).tobytes() + b"".join(sets))])
        key, count = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_counts=True)
        low, count = key.astype(np.uint32), count.astype(np.uint32)
        return batch([(part, pid, low[a:b].tobytes() + count[a:b].tobytes()) for part, a, b in _spread(key, parts)])

    def batch(out: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["part", "pid", "blob"])

    def run(batches):
        total, cls, sets = 0, [], []
        for b in batches:
            for c, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cls.append(c), sets.append(h)
                total += len(h) // 8
                if total >= flush:
                    yield pack(cls[0], cls, sets)
                    total, cls, sets = 0, [], []
        if cls:
            yield pack(cls[0], cls, sets)

    return run


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """For each payload's hashes of this part, in their order, how many classes of all have them. Two hashes with the same
    lower bits count together, which moves both in the order and is the same for every class."""
    n = [len(b) // 8 for b in rows["blob"]]
    low = np.concatenate([np.frombuffer(b, np.uint32, k) for b, k in zip(rows["blob"], n)])
    count = np.concatenate([np.frombuffer(b, np.uint32, k, 4 * k) for b, k in zip(rows["blob"], n)]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    start = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
    total = np.minimum(np.add.reduceat(count[order], start), 0xFFFFFFFF)
    df = np.empty(len(low), np.uint32)
    df[order] = np.repeat(total, np.diff(np.append(start, len(low))))
    at = np.cumsum([0, *n])
    each = [df[a:b] for a, b in zip(at, at[1:])]
    return pd.DataFrame({"pid": rows["pid"], "part": rows["part"], "blob": [(x.astype(np.uint8) if x.max() < 256 else x).tobytes() for x in each]})


def _prefixes(parts: int):
    """h, cls: of each class of a payload the rarest shingles of those that another class has, as many as a link must touch."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        body = rows.loc[rows["part"] < 0, "blob"].iloc[0]
        (k,) = np.frombuffer(body, np.int64, 1).tolist()
        cls, size = np.frombuffer(body, np.int64, 2 * k, 8).reshape(2, -1)
        h = np.frombuffer(body, np.uint64, -1, 8 + 16 * k)
        key, where = np.unique(h, return_inverse=True)
        df = np.empty(len(key), np.uint32)
        got = dict(zip(rows["part"].tolist(), rows["blob"]))
        for part, a, b in _spread(key, parts):
            df[a:b] = np.frombuffer(got[part], np.uint8 if len(got[part]) == b - a else np.uint32)
        df, who = df[where], np.repeat(np.arange(k), size)
        common = df > 1
        h, df, who = h[common], df[common], who[common]
        order = np.lexsort((h, df, who))
        m = np.bincount(who, minlength=k)
        rank = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m) + 1
        keep = order[rank <= (m - -(-7 * size // 10) + 1)[who]]
        return pd.DataFrame({"h": h[keep].view(np.int64), "cls": cls[who[keep]]})

    return run


# --- the R-tree ----------------------------------------------------------------------------------------------


def load(points: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Leaves of a bulk-loaded R-tree: slabs by size, inside a slab by the widest coordinate."""
    order = np.argsort(sizes, kind="stable")
    slab = LEAF * max(1, int(np.ceil(np.sqrt(len(order) / LEAF))))
    leaves = []
    for at in range(0, len(order), slab):
        s = order[at : at + slab]
        s = s[np.argsort(points[s, int(np.argmax(points[s].std(0)))], kind="stable")]
        leaves += [s[k : k + LEAF] for k in range(0, len(s), LEAF)]
    return leaves


def candidates(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) whose summed coordinate minima reach what a link needs; i < j if both sides are one."""
    la = load(a, na)
    lb = la if same else load(b, nb)
    boxa, boxb = np.stack([a[x].max(0) for x in la]), np.stack([b[x].max(0) for x in lb])
    mina, minb = np.array([na[x].min() for x in la]), np.array([nb[x].min() for x in lb])
    out_i, out_j = [], []
    for k, x in enumerate(la):
        bound = np.minimum(boxa[k], boxb).sum(1, dtype=np.int64)
        for t in np.flatnonzero(bound >= need(mina[k], minb)):
            if same and t < k:
                continue
            y = lb[t]
            over = np.minimum(a[x][:, None], b[y][None]).sum(2, dtype=np.int64)
            i, j = np.nonzero(over >= need(na[x][:, None], nb[y][None]))
            i, j = x[i], y[j]
            if same:
                ok = (i < j) if t == k else np.ones(len(i), bool)
                i, j = np.minimum(i, j)[ok], np.maximum(i, j)[ok]
            out_i.append(i), out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def overlaps(sa: list[np.ndarray], sb: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|A and B| of the pairs, on the sets themselves."""
    if len(i) <= 500:
        return np.array([len(np.intersect1d(sa[x], sb[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    ui, ii = np.unique(i, return_inverse=True)
    uj, jj = np.unique(j, return_inverse=True)
    rows = [sa[x] for x in ui] + [sb[y] for y in uj]
    tokens, inv, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    keep = count[inv] > 1
    inv, who = (np.cumsum(count > 1) - 1)[inv[keep]], who[keep]
    order = np.argsort(inv, kind="stable")
    inv, who = inv[order], who[order]
    total = np.zeros((len(ui), len(uj)), np.float32)
    for at in range(0, int((count > 1).sum()), 4096):
        lo, hi = np.searchsorted(inv, (at, at + 4096))
        m = np.zeros((len(rows), 4096), np.float32)
        m[who[lo:hi], inv[lo:hi] - at] = 1
        total += m[: len(ui)] @ m[len(ui) :].T
    return np.rint(total[ii, jj]).astype(np.int64)


def _points(sets: list[np.ndarray]) -> np.ndarray:
    n = [len(x) for x in sets]
    cell = np.repeat(np.arange(len(sets)), n) * GROUPS + (np.concatenate(sets) % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(cell, minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    lab = np.arange(n)
    while len(i):
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _join_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links inside one bin of small families, or one pair of tiles of a large family."""
    out = []
    rows = rows.sort_values(["family", "cls"], kind="stable")
    for _, f in rows.groupby("family", sort=False):
        cls, copies = f["cls"].to_numpy(), f["copies"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in f["hashes"]]
        sizes = np.array([len(x) for x in sets])
        pts = _points(sets)
        left = f["left"].to_numpy()
        if left.all():
            i, j = candidates(pts, sizes, pts, sizes, True)
        else:
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            i, j = candidates(pts[a], sizes[a], pts[b], sizes[b], False) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int))
            i, j = a[i], b[j]
        inter = overlaps(sets, sets, i, j)
        ok = 100 * inter >= 70 * (sizes[i] + sizes[j] - inter)
        i, j = i[ok], j[ok]
        links = np.zeros(len(cls), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        hit = links > 0
        out.append(pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[_roots(len(cls), i, j)][hit], "tiled": bool(f["tiled"].iloc[0])}))
    return pd.concat(out)


# --- the R-tree of a large family --------------------------------------------------------------------------------


def _summaries(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """n, slab (size class), first (first occupied coordinate of the finest grid, which is the smallest hash)."""
    n = np.array([len(x) for x in sets], np.int64)
    slab = np.floor(np.log(n) / np.log(1 / 0.7)).astype(np.int32)
    return {"n": n, "slab": slab, "first": np.array([int(x[0]) >> 1 for x in sets], np.int64)}


def tiles(member: DataFrame, stored: DataFrame) -> DataFrame:
    """cls, family, n, tile of the members of large families. Tiles are the tree's nodes: neighbours in size and in their first
    occupied coordinate, so near copies come together. The sets stay where they are: their summaries are stored beside them."""
    s = member.join(stored.select("cls", "n", "slab", "first"), "cls")
    order = [F.col(c) for c in ("family", "slab", "first", "n", "cls")]
    weight = F.greatest(F.lit(TILE_HASHES // TILE).cast("long"), F.col("n"))  # so a tile is bounded in members and in shingles
    return running(s, order, weight, "_at").withColumn("tile", F.expr(f"_at div {TILE_HASHES}")).drop("_at", "slab", "first")


def place(member: DataFrame, stored: DataFrame) -> DataFrame:
    """cls, copies, hashes, family, tile of the members of families, tile null in families up to TILE. The sets are brought
    to their family and tile by one shuffle, whether there are large families or not."""
    at = member.where(F.col("size") <= TILE).select("cls", "family", F.lit(None).cast("long").alias("tile"))
    large = member.where(F.col("size") > TILE).select("cls", "family")
    if not large.isEmpty():
        at = at.unionByName(tiles(large, stored).select("cls", "family", "tile"))
    return cut(at.join(stored.select("cls", "copies", "hashes"), "cls"))


def _box(rows: pd.DataFrame) -> pd.DataFrame:
    """A tile's box: the largest count of any member in each of FINE groups, the smallest and the largest member."""
    box = np.zeros(FINE, np.int32)
    sizes = []
    for b in rows["hashes"]:
        h = np.frombuffer(b, np.uint64)
        sizes.append(len(h))
        np.maximum(box, np.bincount((h % np.uint64(FINE)).astype(np.int64), minlength=FINE), out=box, casting="unsafe")
    return pd.DataFrame({"family": rows["family"].iloc[:1], "tile": rows["tile"].iloc[:1], "low": min(sizes), "high": max(sizes), "box": [box.tolist()]})


def tile_pairs(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """family, a, b: the pairs of tiles (a <= b) of one family whose boxes can hold a link: summed coordinate minima of
    the boxes and the largest sizes must reach what their smallest members need."""
    side = lambda box, t: box.select("family", *[F.col(c).alias(f"{c}_{t}") for c in ("tile", "low", "high", "box")])
    j = side(boxes, "a").join(side(others, "b"), "family").where("tile_a <= tile_b")
    least = F.expr("(7 * (low_a + low_b) + 16) div 17")
    over = F.aggregate(F.zip_with("box_a", "box_b", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    sized = (F.least("high_a", "high_b") >= least) & (10 * F.col("high_a") >= 7 * F.col("low_b")) & (10 * F.col("high_b") >= 7 * F.col("low_a"))
    keep = (F.col("tile_a") == F.col("tile_b")) | (sized & (over >= least))
    return j.where(keep).select("family", F.col("tile_a").alias("a"), F.col("tile_b").alias("b"))


def tree_blocks(placed: DataFrame) -> DataFrame:
    """cls, copies, hashes, family, block, left, tiled of the placed members of large families: a block is a pair of tiles."""
    boxes = cut(placed.select("family", "tile", "hashes").groupBy("family", "tile").applyInPandas(_box, "family long, tile long, low long, high long, box array<int>"))
    pairs = cut(tile_pairs(boxes, boxes))
    side = lambda p, t, left: p.select("family", F.col(t).alias("tile"), F.concat_ws("/", "family", "a", "b").alias("block"), F.lit(left).alias("left"), F.lit(True).alias("tiled"))
    return placed.join(side(pairs, "a", True).unionByName(side(pairs.where("a < b"), "b", False)), ["family", "tile"]).drop("tile")


# --- the join ------------------------------------------------------------------------------------------------


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    volume = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small_batches(docs.sparkSession)

    def summed() -> DataFrame:  # nothing outlives these calls that refers to their shuffles, so the files can go
        sent = texts.mapInArrow(_payloads(*shape(volume // 6)), "part long, pid long, blob binary")
        shared = sent.groupBy("part").applyInPandas(_shared, "pid long, own boolean, blob binary")
        return cut(shared.groupBy("pid").applyInPandas(_totals, "doc_id long, n long, s1 long, s2 long, shared long"))

    meta = summed()
    release(docs.sparkSession)
    classes = cut(meta.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.max("shared").alias("shared")).withColumn("cls", F.xxhash64("s1", "s2", "n")))
    live = cut(classes.where("10 * shared >= 7 * n").select("cls", "copies", "doc", "s1", "s2"))
    if live.count() <= BROADCAST:  # else both sides are shuffled
        live = F.broadcast(live)

    def sets(b: pa.RecordBatch, memo={}):  # noqa: B006
        # rows of one doc_id may have several texts: a class takes those with its own set
        hs = [shingles(t, memo) for t in b.column(1).to_pylist()]
        own = [signature(h) == s for h, s in zip(hs, zip(b.column(3).to_pylist(), b.column(4).to_pylist()))]
        hs, kept = [h for h, o in zip(hs, own) if o], b.filter(pa.array(own, pa.bool_()))
        facts = {"cls": kept.column(5), "copies": kept.column(2), "hashes": pa.array([h.tobytes() for h in hs], pa.binary())}
        yield pa.RecordBatch.from_pydict(facts | {k: pa.array(v) for k, v in _summaries(hs).items()})

    def hashed(rows: DataFrame) -> DataFrame:
        return per_batch(rows.select("doc_id", "text", "copies", "s1", "s2", "cls"), sets, "cls long, copies long, hashes binary, n long, slab int, first long")

    chosen = texts.join(live, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "copies", "s1", "s2", "cls")
    repeated = cut(chosen.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    n_repeated = repeated.count()
    if n_repeated:  # one hash set a class, however many rows its doc_id has
        if n_repeated <= BROADCAST:
            repeated = F.broadcast(repeated)
        stored = cut(hashed(chosen.join(repeated, "doc_id", "left_anti")).unionByName(hashed(chosen.join(repeated, "doc_id", "left_semi")).dropDuplicates(["cls"])))
    else:
        stored = cut(hashed(chosen))

    parts, flush = shape(stored.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0] // 8)

    def prefixes() -> DataFrame:
        asked, own = (stored.select("cls", "hashes").mapInArrow(_asked(k, flush), "part long, pid long, blob binary") for k in (parts, 0))
        told = asked.groupBy("part").applyInPandas(_frequencies, "pid long, part long, blob binary")
        return cut(told.unionByName(own).groupBy("pid").applyInPandas(_prefixes(parts), "h long, cls long"))

    prefix = prefixes()
    release(docs.sparkSession)
    hub = prefix.groupBy("h").agg(F.min("cls").alias("v"), F.count("*").alias("k")).where("k > 1")
    ties = attach(prefix, hub, ["h"], "k", F.struct("cls")).where("v is not null and v <> cls").select(F.col("cls").alias("u"), "v").distinct()
    family = cut(components(ties))
    del hub, ties
    release(docs.sparkSession)
    sizes = cut(family.groupBy("root").agg(F.count("*").alias("size")))
    bins = max(1, (family.count() + TILE - 1) // TILE)
    member = attach(family.select(F.col("v").alias("cls"), F.col("root").alias("family")), sizes.withColumnRenamed("root", "family"), ["family"], "size", F.struct("cls"))
    placed = place(member, stored)
    del family, member, prefix, sizes, stored  # their checkpoints can go, too
    release(docs.sparkSession)
    blocks = placed.where("tile is null").select("cls", "copies", "hashes", "family", F.concat_ws("/", F.lit("b"), F.pmod(F.xxhash64("family"), F.lit(bins))).alias("block"), F.lit(True).alias("left"), F.lit(False).alias("tiled"))
    large = placed.where("tile is not null")
    if not large.isEmpty():
        blocks = blocks.unionByName(tree_blocks(large))
    linked = cut(blocks.groupBy("block").applyInPandas(_join_block, "cls long, links long, root long, tiled boolean"))
    roots = linked.where("not tiled").select("cls", "root")
    tiled = linked.where("tiled").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    if not tiled.isEmpty():
        roots = roots.unionByName(components(tiled).select(F.col("v").alias("cls"), "root"))
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = cut(roots.groupBy("cls").agg(F.min("root").alias("root")))
    lead = roots.join(classes.select("cls", "doc"), "cls").groupBy("root").agg(F.min("doc").alias("lead"))  # a component's smallest doc_id
    facts = cut(classes.join(links, "cls", "left").join(roots.join(lead, "root").select("cls", "lead"), "cls", "left").select("s1", "s2", "n", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("lead", "doc").alias("component_id")))
    out = attach(meta.select("doc_id", "n", "s1", "s2"), facts, ["s1", "s2", "n"], "copies", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that another document of their component stands for (the smallest doc_id stays)."""
    (key,) = fresh(docs, "_id")
    gone = link(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w WHERE ws <> ['']),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 70 * (x.n + y.n - k)),
c AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v),
r AS (SELECT v, min(r) AS component_id FROM c GROUP BY v),
k AS (SELECT a AS doc_id, count(*) AS n_similar FROM l GROUP BY a)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.n_similar, 0)::BIGINT AS n_similar, r.component_id::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN r ON r.v = d.doc_id
"""
