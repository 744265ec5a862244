"""Personal data by bootstrapped contextual extraction.

Seeds are the spans that the base expressions find, and for the kind `secret` quoted strings of letters and digits that
something is assigned to. Every identifier-like run of the corpus is a mention with lexical patterns (`patterns`):
the two words on its left, on its right, one on each side, the label it follows (`token="`), the run's form, and
the left word with it. In each round, over the bipartite pattern-instance graph by grouped aggregation:

* a pattern's score for a kind is the weight of its instances that are known for the kind, over that of all its instances
  (unknown ones count half); it is accepted with MIN_SEEDS different known instances and a score of MIN_SCORE;
* an instance is as good as the noisy-or of its accepted patterns (seeds are 1), and from MIN_SCORE on it is known, so in the
  next round it induces patterns of its own.

Rounds end when no more instances become known (or after ROUNDS). A mention in the slot of an accepted pattern whose shape
fits the kind, and which the base expressions had missed, becomes a span of that kind. Base spans always stay.

Only mentions are shuffled, never texts; patterns are summed before the shuffle, joins on patterns and instances split hot
ones; what comes back to a document is its own list of spans.

Cases: null and empty texts have no spans; texts are scanned whole, in linear time, with contexts of CONTEXT characters
on each side of a mention; ties in a mention's kinds go to the better score, then the smaller kind; equal rows give equal
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, per_batch, table

KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS, MIN_SEEDS, MIN_SCORE, CONTEXT = 6, 5, 0.8, 80
_LOCAL = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What the expressions may miss: runs of digits with the usual separators, addresses in another form, long codes.
_NUMERIC = re.compile(r"(?<![^\s(\[:=\"'])\+?\(?[0-9][0-9().\-/ ]*[0-9]")
_AT = re.compile(r" ?(?:@|\[at\]|\(at\)) ?", re.I)
_NAME = re.compile(r"[^\s@<>\"'(),;:]*")
_CODE = re.compile(r"[A-Za-z0-9_+=-]++")
_ASSIGNED = re.compile(r"[=:]\s*+[\"']([A-Za-z0-9_+=-]{20,}+)[\"']")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out = []
    at, prev = text.find("@"), 0
    while at >= 0:
        seg = text[prev:at]
        start = prev + len(seg.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        prev = m.end() if m else at + 1
        if m:
            out.append((start, 0, m.end()))
        at = text.find("@", prev)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def mixed(code: str) -> bool:
    """Letters and digits, three of each at least."""
    digits = sum("0" <= c <= "9" for c in code)
    return digits >= 3 and sum(c.isalpha() for c in code) >= 3


def seeds(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the seeds that are no base spans: assigned secrets that overlap none."""
    if '"' not in text and "'" not in text:
        return []
    found = [m.span(1) for m in _ASSIGNED.finditer(text) if mixed(m[1])]
    return [(a, 4, b) for a, b in found if not any(x < b and a < y for x, _, y in base)] if found else []


def shapes(piece: str) -> list[int]:
    """The kinds that a mention could be, by its form alone: looser than the base expressions."""
    digits = sum("0" <= c <= "9" for c in piece)
    low = piece.lower()
    out = []
    if ("@" in piece or "at]" in low or "at)" in low) and "." in piece:
        out.append(0)
    elif digits and not set(piece) - set("0123456789 -./()+"):
        if piece.count(".") == 3 and not set(piece) - set("0123456789."):
            out.append(1)
        if 12 <= digits <= 19 and not set(piece) - set("0123456789 -./"):
            out.append(2)
        if 7 <= digits <= 15 and "/" not in piece:
            out.append(3)
    elif len(piece) >= 12 and mixed(piece):
        out.append(4)
    return out


def shape(piece: str) -> str:
    """The piece with digits as 9 and runs of letters as a; codes are all alike."""
    if _CODE.fullmatch(piece) and mixed(piece):
        return "code"
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", piece))[:40]


def patterns(text: str, start: int, end: int) -> list[str]:
    before = text[max(0, start - CONTEXT) : start]
    words = [(w.group().lower(), w.end()) for w in _WORDS.finditer(before)][-2:]
    left = [w for w, _ in words]
    right = [w.lower() for w in _WORDS.findall(text[end : end + CONTEXT])][:2]
    form = shape(text[start:end])
    out = [] if form == "code" else ["F " + form]
    if len(left) == 2:
        out.append("L " + " ".join(left))
    if len(right) == 2:
        out.append("R " + " ".join(right))
    if left and right:
        out.append(f"B {left[-1]} {right[0]}")
    if left:
        marks = "".join(before[words[-1][1] :].split())
        if marks:
            out.append(f"K {left[-1]}{marks[:8]}")
            out.append(f"K {left[-1]}{marks[:1]}")
        out.append(f"S {left[-1]} {form}")
    return list(dict.fromkeys(out))


def _numeric(text: str, taken: list[tuple[int, int]]):
    """Runs of digits and separators, cut at what is taken; a run that fits no kind is cut at its spaces."""
    i = 0
    for m in _NUMERIC.finditer(text):
        a, z = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        cuts, k = [], i
        while k < len(taken) and taken[k][0] < z:
            cuts.append(taken[k])
            k += 1
        for x, y in zip([a, *(e for _, e in cuts)], [*(s for s, _ in cuts), z]):
            while x < y and text[x] not in "0123456789+(":
                x += 1
            while x < y and not "0" <= text[y - 1] <= "9":
                y -= 1
            if x >= y:
                continue
            if shapes(text[x:y]) or " " not in text[x:y]:
                yield x, y
                continue
            for w in re.finditer(r"[^ ]+", text[x:y]):
                yield x + w.start(), x + w.end()


def _addresses(text: str):
    """Something, an at sign or what stands for it, and something, in linear time: each sign takes what is left since the last."""
    prev = 0
    for m in _AT.finditer(text):
        if m.start() < prev:
            continue
        left = _NAME.match(text[prev : m.start()][::-1]).end()
        right = _NAME.match(text, m.end()).end()
        if left and right > m.end():
            yield m.start() - left, right
            prev = right
        else:
            prev = m.end()


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, list[int], list[str], bool]]:
    """(start, end, instance, kinds it could be, patterns, is a seed): base spans, other seeds, and identifier-like runs
    that overlap neither."""
    known = sorted(base + seeds(text, base))
    found = [(a, b, text[a:b], [k], patterns(text, a, b), True) for a, k, b in known]
    taken = []  # base spans of different kinds may overlap
    for a, _, b in known:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    runs = []
    if _DIGIT.search(text):
        runs += _numeric(text, taken)
        runs += [m.span() for m in _CODE.finditer(text) if m.end() - m.start() >= 12 and mixed(m.group())]
    if _AT.search(text):
        runs += _addresses(text)
    i = last = 0
    for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < last or (i < len(taken) and taken[i][0] < b):
            continue
        if kinds := shapes(text[a:b]):
            found.append((a, b, text[a:b], kinds, patterns(text, a, b), False))
            last = b
    return found


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])
_SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<struct<start:long,end:long,instance:string,kinds:array<int>,patterns:array<string>,seed:boolean>>"


def _scan(batch: pa.RecordBatch):
    cols: list[list] = [[] for _ in range(7)]
    for t in batch.column(1).to_pylist():
        t = t or ""
        spans = base_spans(t)
        said = digest(spans)
        for k in range(4):
            cols[k].append(sum(s[1] == k for s in spans))
        cols[4].append(hashlib.sha256(said.encode()).hexdigest())
        cols[5].append(said)
        cols[6].append([dict(zip(("start", "end", "instance", "kinds", "patterns", "seed"), m)) for m in mentions(t, spans)])
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(_MENTION)]
    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, x) for c, x in zip(cols, types)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: base counts, digest and spans, and its mentions."""
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, _SCAN)


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """The accepted patterns: pattern, kind, score, support (known instances), n (weight of all its mentions)."""
    m = scanned.select(F.explode("mentions").alias("m")).select(F.col("m.instance").alias("instance"), F.explode("m.kinds").alias("kind"), F.col("m.patterns").alias("patterns"), F.col("m.seed").alias("seed"))
    edges = m.select("instance", "kind", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("w"))
    # a pattern can only be accepted with so many instances at all
    slots = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds)
    edges = cut(edges)
    graph = cut(attach(edges, cut(slots), ["pattern", "kind"], "n", F.col("instance")).where("n is not null").drop("n"))
    sizes = cut(graph.groupBy("kind", "instance").agg(F.count("*").alias("m"), F.max("seed").alias("seed")))
    known = sizes.where("seed").select("kind", "instance", F.lit(1.0).alias("score"), "m")
    count, accepted = -1, None
    for _ in range(rounds):
        known = cut(known)
        total = known.count()
        if total == count:
            break
        count = total
        weighed = attach(graph, known, ["kind", "instance"], "m", F.col("pattern"))
        good = F.sum(F.col("w") * F.coalesce("score", F.lit(0.0)))
        doubt = F.sum(F.when(F.col("score").isNull(), F.col("w")).otherwise(0)) * 0.5 + F.sum(F.col("w") * (1 - F.coalesce("score", F.lit(1.0))))
        accepted = cut(weighed.groupBy("pattern", "kind").agg((good / (good + doubt + 0.1)).alias("score"), F.count("score").alias("support"), F.sum("w").alias("n")).where((F.col("support") >= min_seeds) & (F.col("score") >= min_score)))
        held = attach(graph.drop("seed"), accepted.select("pattern", "kind", "score", "n"), ["pattern", "kind"], "n", F.col("instance")).where("score is not null")
        by_instance = held.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("s"))
        known = sizes.join(by_instance, ["kind", "instance"], "left").select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("s")).alias("score"), "m").where(F.col("score") >= min_score)
    return accepted


def find(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, counts, base_sha256, spans (base and added), n_spans, n_added, n_discovered (those of them that are no seeds)."""
    s = cut(scan(docs).withColumn("row", F.xxhash64("doc_id", "base_sha256", "mentions")))
    accepted = bootstrap(s, **kw)
    open_ = s.select("row", F.explode("mentions").alias("m")).where("not m.seed").select("row", "m.start", "m.end", F.explode("m.kinds").alias("kind"), F.col("m.patterns").alias("ps")).select("row", "start", "end", "kind", F.explode("ps").alias("pattern"))
    hits = attach(open_, accepted, ["pattern", "kind"], "n", F.struct("row", "start")).where("score is not null")
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("row", "start", "end", (-F.col("b.k")).alias("kind"))
    extra = best.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))  # one document's own spans
    span = "array<struct<start:bigint,kind:int,end:bigint>>"
    names = F.array(*[F.lit(k) for k in KINDS])
    parsed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), (F.array_position(names, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[2].cast("long").alias("end")))
    own = F.transform(F.filter("mentions", lambda m: m["seed"] & (m["kinds"][0] > 3)), lambda m: F.struct(m["start"].alias("start"), m["kinds"][0].alias("kind"), m["end"].alias("end"))).cast(span)
    s = s.withColumn("own", own).drop("mentions").join(extra, "row", "left").withColumn("extra", F.coalesce("extra", F.array().cast(span)))
    spans = F.array_sort(F.concat(parsed, "own", "extra"))
    text = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda c: F.size(c).cast("long")
    return s.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), n(spans).alias("n_spans"), (n("own") + n("extra")).alias("n_added"), n("extra").alias("n_discovered"))


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
