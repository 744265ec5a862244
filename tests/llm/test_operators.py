"""The training-data operators against brute force, on small invented tables and on the smallest supplied ones."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from palimpsest.llm import ann, chat_format, common, jaccard_join, line_dedup, mixing, pii, quality_classifier, quality_rules, sentence_pieces, sharding
from palimpsest.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CLASH = ("_id", "_m", "_t", "_nos", "_removed", "_chars", "h", "size", "row", "shard", "cell", "n", "taken", "rank")


def make(spark, texts, sources=None, extra=False):
    data = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in CLASH:
            df = df.withColumn(c, F.lit("x"))
    return df


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


ODD = [None, "", " \n\t ", "one", "two words", "A" * 5000, "word " * 3000, "same text here for all", "same text here for all", "é ñ 日本 😀 x", "a\nb\nc\n", "\x1c\x85\xa0 odd spaces"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


OPERATORS = {
    "rules": lambda s, d: quality_rules.apply_policy(quality_rules.ledger(d)),
    "filter": lambda s, d: quality_rules.filter_documents(d),
    "shards": lambda s, d: sharding.shard_documents(d),
    "mix": lambda s, d: mixing.plan_mix(d)[0],
    "mixed": lambda s, d: mixing.mix_documents(d),
    "lines": lambda s, d: line_dedup.clean(d),
    "link": lambda s, d: jaccard_join.link(d),
    "keep": lambda s, d: jaccard_join.keep_one(d),
    "pieces": lambda s, d: sentence_pieces.encode_documents(d),
    "pii": lambda s, d: pii.find(d),
    "quality": lambda s, d: quality_classifier.classify(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
}
ONE_ROW_EACH = {"rules", "shards", "mix", "lines", "link", "pieces", "pii", "quality"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    d = make(spark, ODD, {3: None}, extra=True)
    d = d.unionByName(d.where("doc_id = 4"))  # a repeated row
    out = OPERATORS[name](spark, d).toPandas()
    if name in ONE_ROW_EACH:
        assert sorted(out["doc_id"]) == sorted([*range(len(ODD)), 4])
    if name in ("filter", "keep", "mixed", "lines"):
        assert set(CLASH) <= set(out.columns)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, make(spark, [])).count() == 0


def test_attach_spreads_hot_keys_and_keeps_rows(spark):
    r = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    f = r.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    out = common.attach(r, f.where("k < 40"), ["k"], "n", F.col("id"))
    assert out.count() == 5000 and out.where("s is null").count() == r.where("k >= 40").count()
    assert out.where("k = 0").select("s").distinct().count() == 1


def test_components(spark):
    rng = random.Random(3)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    got = {r.v: r.root for r in common.components(spark.createDataFrame(e, "u long, v long")).collect()}
    lab = {x: x for p in e for x in p}
    for _ in range(300):
        for a, b in e:
            lab[a] = lab[b] = min(lab[a], lab[b])
    assert got == {v: r for v, r in lab.items() if any(v in p and p[0] != p[1] for p in e)}


def test_repeat_words_brute():
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(60))]
        g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert quality_rules.repeat_words(w) == len(hit)


def test_rules_bits_filter_and_ablation(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    led = quality_rules.apply_policy(quality_rules.ledger(d)).toPandas()
    kept = {r.doc_id for r in quality_rules.filter_documents(d).collect()}
    assert kept == set(led.doc_id[led.kept])
    ab = quality_rules.ablations(quality_rules.ledger(d)).toPandas().set_index("rule")
    for rule, bit in quality_rules.BITS.items():
        assert ab.loc[rule, "fails_alone"] == (led.failed_bits == bit).sum()
        assert ab.loc[rule, "kept_without"] == ((led.failed_bits & ~bit) == 0).sum()


def test_shards(spark):
    rng = random.Random(5)
    texts = [("w" * rng.randrange(1, 9) + " ") * rng.randrange(1, 40) for _ in range(900)] + ["hot text in many copies"] * 500
    out = sharding.shard_documents(make(spark, texts), 8).toPandas()
    by = {i: t for i, t in enumerate(texts)}
    assert all(r.size == len(by[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(by[r.doc_id].encode()) for r in out.itertuples())
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.05 * sums.mean()
    assert out[out.doc_id < 900].assign(t=lambda x: x.doc_id.map(by)).groupby("t").shard.nunique().max() == 1


def test_mixing_brute(spark):
    rng = random.Random(2)
    src = {i: rng.choice(["a", "b", "c", "d", None]) for i in range(400)}
    texts = ["w " * rng.randrange(0, 50) for _ in range(400)]
    d = make(spark, texts, src)
    out = mixing.plan_mix(d)[0].drop("src").toPandas().assign(src=lambda x: x.doc_id.map(src).fillna("~"))
    size = out.groupby("src")["size"].sum()
    names = sorted(set(size.index) - {"~"}) + ["~"]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, open_, target = 1.5 * size.sum(), set(names), {}
    while open_:
        w = sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * left / w > 2 * size[n]}
        if not over:
            target |= {n: weight[n] * left / w for n in open_}
            break
        for n in over:
            target[n] = 2.0 * size[n]
        left -= sum(target[n] for n in over)
        open_ -= over
    g = out.groupby("src").agg(t=("target", "first"), k=("taken", "sum"))
    for n in names:
        assert abs(g.t[n] - target[n]) < 1e-6 * max(1, target[n])
        assert abs(g.k[n] - target[n]) <= 2 + 0.01 * target[n]
    assert (out.taken <= 2 * out["size"]).all()
    again = mixing.plan_mix(d.repartition(3))[0].toPandas()
    cols = ["doc_id", "size", "taken", "shard_words"]
    assert rows(out[cols]) == rows(again[cols])
    assert (out.shard_words.map(sum) == out.taken).all()
    mixed = mixing.mix_documents(d).toPandas()
    assert mixed.text.map(lambda t: len(words(t))).groupby(mixed.doc_id).sum().to_dict() == {r.doc_id: r.taken for r in out.itertuples() if r.taken}


def test_sainte_lague_seats(spark):
    t = {"a": 53.0, "b": 24.0, "c": 24.0, "d": 7.0, "e": 1.0}
    d = spark.createDataFrame([((False, k), v) for k, v in t.items()], "src struct<no:boolean,name:string>, target double")
    houses = [0, 1, 2, 7, 20, 101]
    got = {r.src.name: list(r.seats) for r in mixing.seats(d, houses).collect()}
    for i, h in enumerate(houses):
        want = Counter(k for _, k in sorted((-v / (j - 0.5), k) for k, v in t.items() for j in range(1, h + 1))[:h])
        assert {k: s[i] for k, s in got.items()} == {k: want[k] for k in t}


def brute_runs(texts):
    """The texts without the lines of runs that occur earlier: every run of two lines or more is compared as it
    stands with what comes before it, line by line; no chunks, no hashes."""
    split = []
    for t in texts:
        ls = []  # each line with words, with the blank lines after it
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                ls.append([x, []])
            elif ls:
                ls[-1][1].append(x)
        split.append(ls)
    out = []
    for d, t in enumerate(texts):
        drop, mine = set(), split[d]
        for i in range(len(mine)):
            for e in range(d + 1):
                for j in range(len(split[e]) if e < d else i):
                    n = 0
                    while i + n < len(mine) and j + n < len(split[e]) and mine[i + n][0] == split[e][j + n][0]:
                        n += 1
                        if mine[i + n - 1][1] != split[e][j + n - 1][1]:
                            break
                    if n > 1:
                        drop |= set(range(i, i + n)) - (set(range(j, j + 2)) if e == d and i == j + 1 else set())
        kept = [[x, *blank] for k, (x, blank) in enumerate(mine) if k not in drop]
        out.append(t if not drop else "\n".join(y for z in kept for y in z).rstrip("\n"))
    return out


def test_line_runs_brute(spark):
    rng = random.Random(19)
    line = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(9))
    shared = [[line() for _ in range(k)] for k in (2, 2, 3, 3, 4, 5, 6, 9)]
    texts = []
    for k in range(90):
        ls = [line() for _ in range(rng.randrange(0, 6))] + rng.choice(shared) + [line() for _ in range(rng.randrange(0, 5))]
        texts.append(("\n" if k % 3 else "\n\n").join(ls))
    texts += [None, "", "one line only", "one line only", texts[0], "x\nx\nx\nx", "y y\nx\nx\nz", "a\nb\na\nb\na"]
    d = make(spark, texts)
    out = line_dedup.clean(d).toPandas().sort_values("doc_id")
    assert out.text.tolist() == brute_runs(texts)
    assert (out.n_chars == out.text.map(lambda t: len(t or ""))).all()
    # recall: what a first place doesn't hold is gone, also runs of two lines
    first = set()
    for t, new in zip(texts[:90], out.text):
        for run in shared:
            if "\n".join(run) in t:
                assert not (tuple(run), t.count("\n\n") > 0) in first or run[0] not in new.split("\n")
                first.add((tuple(run), t.count("\n\n") > 0))
    assert rows(line_dedup.clean(d.repartition(5)).toPandas()) == rows(out)


def test_line_runs_rows_of_one_doc_id(spark):
    d = spark.createDataFrame([(1, "a\nb\nc"), (2, "k\na\nb"), (2, "m\nn\no"), (2, "m\nn\no")], "doc_id long, text string")
    out = line_dedup.clean(d.withColumn("_row", F.lit("x"))).toPandas()
    assert sorted(out.text) == ["a\nb\nc", "k", "m\nn\no", "m\nn\no"] and set(out._row) == {"x"}
    assert line_dedup.clean(d.limit(0)).count() == 0


def test_op8_removes_every_repeated_run(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op8_line_dedup"](spark, SF).toPandas().set_index("doc_id").text
    seen, n = set(), 0
    for i, t in zip(d.doc_id, d.text):
        ls = [x for x in (t or "").split("\n") if x.strip()] if "\n\n" not in (t or "") else []
        for p in zip(ls, ls[1:]):
            if p in seen and ls.count(p[0]) == ls.count(p[1]) == 1:
                n += 1
                assert not {*p} & {*got[i].split("\n")}
            seen.add(p)
    assert n > 50


def test_jaccard_brute(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    texts = []
    for _ in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "NEW" + str(rng.randrange(99))
        texts.append(" ".join(w))
    texts += [None, "", "  ", "a", "A", "a b", "b a"]
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard_join.link(make(spark, texts)).collect()}
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := words(t)) else set() for t in low]
    links = {i: [j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])] for i in range(len(sets))}
    comp = {i: i for i in links}
    for _ in links:
        for i, js in links.items():
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == {i: (len(sets[i]), len(links[i]), comp[i]) for i in links}


def test_jaccard_counts_repeated_rows_once(spark):
    a, c = [f"a{i}" for i in range(40)], [f"c{i}" for i in range(40)]
    text = lambda w, last=None: " ".join(w[:-1] + [last or w[-1]])
    data = [(5, text(a)), (5, text(a)), (6, text(a, "x")), (7, text(c)), (7, text(a, "y")), (8, text(c, "z")), (8, text(c, "Z")), (9, "alone")]
    got = sorted((r.doc_id, r.n_similar, r.component_id) for r in jaccard_join.link(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(5, 3, 5), (5, 3, 5), (6, 3, 5), (7, 2, 7), (7, 3, 5), (8, 2, 7), (8, 2, 7), (9, 0, 9)]
    few = spark.createDataFrame(data[:3], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_similar) for r in jaccard_join.link(few).collect()) == [(5, 2), (5, 2), (6, 2)]


def test_large_families_go_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    monkeypatch.setattr(jaccard_join, "TILE_HASHES", 640)
    rng = random.Random(6)
    w = [str(i) for i in range(80)]
    texts = []
    for i in range(60):
        x = list(w)
        for _ in range(rng.randrange(1, 5)):
            x[rng.randrange(80)] = f"n{rng.randrange(999)}"
        texts.append(" ".join(x))
    test = {r.doc_id: (r.n_similar, r.component_id) for r in jaccard_join.link(make(spark, texts)).collect()}
    sets = [{tuple(v[i : i + 3]) for i in range(78)} for v in map(str.split, texts)]
    n = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]) for j in range(60)) for i in range(60)}
    assert {k: v[0] for k, v in test.items()} == n and sum(n.values())


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 6, (150, jaccard_join.GROUPS)).astype(np.int32)
    p[75:] = np.maximum(0, p[:75] + (rng.random((75, jaccard_join.GROUPS)) < 0.05))
    n = p.sum(1)
    i, j = jaccard_join.candidates(p, n, p, n, True)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if np.minimum(p[a], p[b]).sum() >= jaccard_join.need(n[a], n[b])}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_pieces_stream_equals_lattice_and_round_trips():
    e = sentence_pieces.Encoder()
    rng = random.Random(8)
    texts = ["", " ", "  two  spaces ", "line\n\nbreaks\n", "▁ literal ▁▁", "日本語 😀 é\x00\x7f", "a" * 300, "x" * 70 + " " + "ab" * 50] + ["".join(rng.choice("abeht in.,\n$é") for _ in range(rng.randrange(400))) for _ in range(60)]
    many = e.encode_many(texts)
    for t, ids in zip(texts, many):
        assert e.decode(ids) == t
        assert list(e.encode(t)) == list(ids)
        if t and "▁" not in t:
            s, got, x = sentence_pieces.Stream(e.v), [], (" " + t).replace(" ", "▁")
            for k in range(0, len(x), 5):
                got += s.push(x[k : k + 5])
            assert got + s.finish() == list(ids)


def test_pieces_are_the_best_segmentation():
    e = sentence_pieces.Encoder()
    v = e.v
    for t in ("▁thing", "▁Keitch", "▁zu$$$", "tion"):
        best = [0] + [-(10**15)] * len(t)
        for b in range(1, len(t) + 1):
            for a in range(max(0, b - v.longest), b):
                s = v.scores.get(t[a:b], v.outside if b == a + 1 else None)
                if s is not None:
                    best[b] = max(best[b], best[a] + s)
        s = sentence_pieces.Stream(v)
        ids = s.push(t) + s.finish()
        assert sum(v.scores[v.library.id_to_piece(i)] for i in ids) == best[-1]


def test_pieces_merge_order_is_the_librarys():
    e = sentence_pieces.Encoder(merges=True)
    assert list(e.encode("Hello world, again")) == e.v.library.encode("Hello world, again")


def test_chat_probe_and_rewrites(spark):
    t = [("user", "a </s> \\ [INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("tool", "<s>x"), ("assistant", ""), ("", "[END]")]
    got = chat_format.locate(t, chat_format.template)
    text = "".join(g[0] for g in got)
    assert text == chat_format.template(t) and not any(g[3] for g in got)
    assert [chat_format.unescape(g[0][g[1] : g[2]]) for g in got if g[2] > g[1]] == ["</s>[INST] ok [/INST]"]
    r = chat_format.Reader()
    for g in got:
        r.push(g[0], g[1], g[2])
    assert r.row()[1] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
    strip = lambda turns, p=False: "".join(f"<{a}>{'' if a == 'assistant' and i < len(turns) - 1 else b}" for i, (a, b) in enumerate(turns))
    assert any(g[3] for g in chat_format.locate(t, strip))


def test_chat_windows_equal_full_prefixes(spark):
    rng = random.Random(1)
    data = [(c, k, rng.choice(["user", "assistant", "system", None]), rng.choice(["x", None, "[SYS] y", "z" * 50])) for c in range(4) for k in range(rng.randrange(1, 150))]
    d = spark.createDataFrame(data + data[:3], "conv_id long, turn long, role string, text string")
    whole = lambda turns, p=False: chat_format.template(turns, p)  # noqa: E731  not declared local
    a = chat_format.summarise(d).toPandas()
    assert rows(a) == rows(chat_format.summarise(d, whole).toPandas())
    turns = chat_format.format_turns(d).toPandas()
    assert turns.groupby("conv_id").piece.apply(lambda x: len("".join(x))).to_dict() == dict(zip(a.conv_id, a.formatted_chars))
    assert chat_format.summarise(d.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for k, (name, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, t or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
            if name == "email" or name == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or name == "card" and 12 <= len(digits) <= 19 and luhn or name == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_brute():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("a.@1-+2 5()_%é0") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == brute_pii(t), t
    t = "4539 1488 0343 6467 x 4539-1488-0343-6467 1.2.3.4.5.6.7.8 0000001.2.3.255 +1 (706) 555-3138 a@b.c_d@e.f"
    assert pii.base_spans(t) == brute_pii(t)


def test_pii_discovers_by_context(spark):
    rng = random.Random(3)
    seeds = [f"please call me at +1 706 555 {rng.randrange(1000, 9999)} after noon" for _ in range(40)]
    texts = seeds + ["please call me at 706 555 1234 after noon", "the sum of 706 555 1234 apples", None]
    out = pii.find(make(spark, texts)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert out.n_discovered.tolist() == [0] * 40 + [1, 0, 0]
    assert out.spans[40] == "phone:18:30" and (out.n_phone[:40] == 1).all()


def test_ann_recall_and_odd_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = [(100001, None), (100002, []), (100003, [0.0] * 64), (100004, [None] + [1.0] * 63), (100005, [float("nan")] * 64), (100006, [float("inf")] * 64), (100050, [1.0, 2.0])]
    d = e.unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    out = ann.search(d, F.col("id") % 50 == 0).toPandas()
    p = e.toPandas()
    x = np.array(p.embedding.tolist(), float)
    ids = p.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        want = [(ids[i], s[i]) for i in np.lexsort((ids, -s))[:5]]
        mine = out[out.query_id == ids[q]].sort_values("rank")
        assert len(mine) == 5 and (mine.score.diff().dropna() <= 0).all()
        hits += len({i for i, _ in want} & set(mine.vec_id))
        total += 5
        assert all(abs(s[np.flatnonzero(ids == r.vec_id)[0]] - r.score) < 1e-12 for r in mine.itertuples())
    assert hits / total >= 0.9
    assert ann.search(d.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(few, F.col("id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [1, 2, 50]


def test_ann_copies_take_one_place(spark):
    """More copies in a block than are scored again: the smaller ids come first, true neighbours stay."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[300:800] = x[0]  # 501 copies
    x[800:1100] = x[1] * rng.integers(1, 9, 300)[:, None]  # the same direction at other lengths
    x[1100:1300] = x[2] + 0.3 * rng.normal(size=16)  # copies near a query that isn't one of them
    ids = rng.permutation(1500) * 3
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    queries = [int(ids[k]) for k in (0, 2, 5, 300, 301, 700, 1200)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for qi in queries:
        s = np.round(unit @ unit[ids == qi][0], 12)
        s[ids == qi] = -9
        want[qi] = ids[np.lexsort((ids, -s))[:5]].tolist()
    for shuffled in (d, d.orderBy(F.desc("vec_id")).repartition(3)):
        out = ann.search(shuffled, F.col("id").isin(queries)).toPandas().sort_values(["query_id", "rank"])
        assert out.groupby("query_id").vec_id.apply(list).to_dict() == want
    code = np.zeros((1500, 4), np.uint8)  # all scores tie: all are scored again
    books = np.ones((8, 16, 2))
    a, b, s = ann.search_block(x[:3], ids[:3], x, ids, code, books, 5, 128)
    assert [set(ids[b[a == i]]) for i in (0, 2)] == [set(want[int(ids[i])]) for i in (0, 2)]
    same = np.tile(x[:1], (400, 1))  # one id many times over is never its own neighbour
    many = np.repeat([7, 9], [399, 1])
    a, b, s = ann.search_block(same[:1], many[:1], same, many, code[:400], books, 5, 128)
    assert many[b].tolist() == [9]


def test_anisotropic_loss_beats_plain_on_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    err = {}
    for eta in (1.0, 4.0):
        b = ann.train(x, eta)
        r = ann._split(x) - b[np.arange(8)[None], ann.assign(ann._split(x), b, eta)]
        err[eta] = float((((r * ann._split(x)).sum((1, 2))) ** 2).mean())
    assert err[4.0] < err[1.0]


def test_quality_held_out(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = y.where("doc_id % 2 = 0")
    out = quality_classifier.classify(d, train).join(y.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((out.quality == 1) == out.kept).mean() > 0.95
    assert out.p_host.between(0, 1).all() and out.p_path.between(0, 1).all()


def test_sparse_sites_shrink(spark):
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(200)] + [(200, 0, 0)], "doc_id long, quality int, toxic int")
    texts = ["some words in a row here"] * 201
    out = quality_classifier.classify(make(spark, texts, {**{i: f"s{i % 4}" for i in range(200)}, 200: "tiny"}), labels).toPandas().set_index("doc_id")
    assert abs(out.p_path[200] - 0.9) < 0.05  # one bad label alone says little, and nothing about itself


def test_ann_repeated_queries_and_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 8))
    data = [(k, x[k].tolist()) for k in range(80)] + [(50, x[50].tolist())] + [(200 + k, x[k, :3].tolist()) for k in range(10)]
    got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).toPandas()
    for q, dim, rows_ in ((50, 8, range(80)), (0, 8, range(80)), (200, 3, range(200, 210))):
        u = {i: np.array(v) / np.linalg.norm(v) for i, v in data if len(v) == dim and i in rows_}
        want = sorted((i for i in u if i != q), key=lambda i: (-float(u[i] @ u[q]), i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and mine["rank"].tolist() == [1, 2, 3, 4, 5]


def test_ann_recall_at_20000(spark):
    """Against brute force on 20,480 generated vectors; with shuffled codes the same search must lose most of it."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(400, 48))
    x = (centres[rng.integers(0, 400, 20480)] + 0.7 * rng.normal(size=(20480, 48))).astype(np.float32)
    import pandas as pd

    d = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20480), "embedding": x.tolist()}))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    queries = np.arange(0, 20480, 50)
    s = unit[queries] @ unit.T
    s[np.arange(len(queries)), queries] = -9
    want = {int(q): set(np.argsort(-row)[:5].tolist()) for q, row in zip(queries, s)}
    got = ann.search(d, F.col("id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set).to_dict()
    recall = np.mean([len(want[q] & got[q]) / 5 for q in want])
    assert recall >= 0.9
    books = ann.train(unit[:4000])
    codes = ann.encode(unit[:16384], books)
    a, b, _ = ann.search_block(x[queries[:40]].astype(float), queries[:40], x[:16384].astype(float), np.arange(16384), codes[rng.permutation(16384)], books, 5, 128)
    lost = np.mean([len(want[int(q)] & set(b[a == i].tolist())) / 5 for i, q in enumerate(queries[:40])])
    assert lost < 0.2


@pytest.mark.parametrize("kind", ["tight clusters", "a common part", "heavy tails", "few dimensions"])
def test_ann_finds_the_nearest_of_other_rows(kind):
    """Rows whose quantised scores say little: nearest vectors are found all the same."""
    rng = np.random.default_rng(3)
    n = lambda *shape: rng.normal(size=shape)
    x = {"tight clusters": lambda: n(10, 32)[rng.integers(0, 10, 6000)] + 0.05 * n(6000, 32), "a common part": lambda: 0.1 * n(6000, 32) + 3, "heavy tails": lambda: n(6000, 32) ** 3, "few dimensions": lambda: n(6000, 3) @ n(3, 32)}[kind]()
    unit, ids, at = x / np.linalg.norm(x, axis=1, keepdims=True), rng.permutation(6000), np.arange(0, 6000, 50)
    books = ann.train(unit[:2000])
    codes = ann.encode(unit, books)
    a, b, _ = ann.search_block(x[at], ids[at], x, ids, codes, books, 5, ann.RERANK, ann.fidelity(unit, codes, books))
    for i, q in enumerate(at):
        s = unit @ unit[q]
        s[q] = -9
        assert set(b[a == i]) == set(np.argsort(-s)[:5])


def test_pii_mentions_take_linear_time():
    import time

    def cost(t):
        at = time.process_time()
        pii.mentions(t, pii.base_spans(t))
        return time.process_time() - at

    for piece in ("A" * 50, "1 ", "@ ", '= "', "1.2.3.", "(((1", "[at] "):
        small, large = cost(piece * 2000 + " x@ "), cost(piece * 16000 + " x@ ")
        assert large < 40 * max(small, 0.01)


def brute_bootstrap(texts, rounds=pii.ROUNDS, min_seeds=pii.MIN_SEEDS, min_score=pii.MIN_SCORE):
    """The accepted patterns, by plain loops over the mentions."""
    graph = {}
    seed = set()
    for t in texts:
        t = t or ""
        for _, _, inst, kinds, pats, is_seed in pii.mentions(t, pii.base_spans(t)):
            for k in kinds:
                if is_seed:
                    seed.add((k, inst))
                for p in pats:
                    graph.setdefault((p, k), Counter())[inst] += 1
    known, accepted = {x: 1.0 for x in seed}, {}
    for _ in range(rounds):
        accepted = {}
        for (p, k), insts in graph.items():
            good = sum(w * known.get((k, i), 0.0) for i, w in insts.items())
            doubt = sum(w * (1 - known[k, i] if (k, i) in known else 0.5) for i, w in insts.items())
            support = sum((k, i) in known for i in insts)
            if support >= min_seeds and good / (good + doubt + 0.1) >= min_score:
                accepted[p, k] = good / (good + doubt + 0.1)
        miss = {}
        for (p, k), s in accepted.items():
            for i in graph[p, k]:
                miss[k, i] = miss.get((k, i), 1.0) * max(1e-9, 1 - s)
        new = {x: 1 - m for x, m in miss.items() if 1 - m >= min_score} | {x: 1.0 for x in seed}
        if len(new) == len(known):
            break
        known = new
    return accepted


def planted_pii(rng):
    """Texts with identifiers in forms that the base expressions miss, and the spans that must be found. The second
    context ("desk line") holds no base span at all: only what the first one teaches leads to it."""
    texts, want = [], {}

    def add(before, what, after, kind=None):
        if kind:
            want[len(texts)] = f"{kind}:{len(before)}:{len(before) + len(what)}"
        texts.append(before + what + after)

    numbers = [f"706 555 {1000 + 37 * k}" for k in range(12)]
    for k in range(60):
        add("please call me at ", f"+1 706 555 {rng.randrange(1000, 9999)}", f" after noon w{k}")
    for n in numbers:
        add("please call me at ", n, " after noon", "phone")
    for n in numbers + ["706 555 9999", "706.555.8888"]:
        add("desk line ", n, " extension open", "phone")
    for k in range(12):
        add("my api token = ", f'"{rng.getrandbits(160):040x}"', " stays")
    for k in range(5):
        add("the api token = ", f"ab{k}cd{rng.getrandbits(40):010x}9x7y", " expired", "secret")
    for k in range(20):
        add("we counted ", f"{rng.randrange(10**6, 10**7)}", f" apples and pears {k}")
    return texts, want


def test_pii_rounds_find_what_base_spans_never_touch(spark):
    texts, want = planted_pii(random.Random(5))
    out = pii.find(make(spark, texts)).toPandas().set_index("doc_id").sort_index()
    hit = {i for i, s in want.items() if s in out.spans[i].split(",")}
    wrong = [i for i in out.index if i not in want and out.n_discovered[i]]
    assert len(hit) / len(want) >= 0.95 and not wrong
    one = pii.find(make(spark, texts), rounds=1).toPandas().set_index("doc_id")
    desk = [i for i, t in enumerate(texts) if t.startswith("desk line")]
    assert not any(one.n_discovered[desk]) and all(out.n_discovered[desk])  # a second generation of patterns
    scanned = pii.scan(make(spark, texts))
    got = {(r.pattern, r.kind): r.score for r in pii.bootstrap(scanned).collect()}
    brute = brute_bootstrap(texts)
    assert got.keys() == brute.keys() and all(abs(got[k] - brute[k]) < 1e-6 for k in got)


def test_posterior_brute(spark):
    """Shrinkage and posterior of every document against plain loops."""
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    y = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_classifier.classify(d, y).toPandas()
    info = {r.doc_id: ("=" + r.source if r.source is not None else "", "=" + r.lang if r.lang is not None else "") for r in d.collect()}
    lab = {}
    for r in y.collect():
        if r.quality is not None and r.doc_id in info:
            lab[r.doc_id] = min(lab.get(r.doc_id, 1.0), float(r.quality > 0))
    p = {r.doc_id: 1 / (1 + np.exp(-r.evidence)) for r in out.itertuples()}
    own = {i: lab.get(i, p[i]) for i in p}

    def strength(groups):
        s = sum((k - n * m) ** 2 / (n * max(1e-9, m * (1 - m))) for k, n, m in groups)
        n1, n2 = sum(n for _, n, _ in groups), sum(n * n for _, n, _ in groups)
        rho = (s - (len(groups) - 1)) / max(1e-9, n1 - n2 / n1 - (len(groups) - 1))
        rho = min(0.99, max(1e-4, rho))
        return (1 - rho) / rho

    host, path = {}, {}
    for i, (h, lang) in info.items():
        for table, key in ((host, h), (path, (h, lang))):
            k, n = table.get(key, (0.0, 0))
            table[key] = (k + own[i], n + 1)
    p0 = min(1 - 1e-3, max(1e-3, sum(own.values()) / len(own)))
    s1 = strength([(k, n, p0) for k, n in host.values()])
    s2 = strength([(k, n, (host[h][0] + s1 * p0) / (host[h][1] + s1)) for (h, _), (k, n) in path.items()])
    prior = min(1 - 1e-3, max(1e-3, np.mean([lab[i] for i in lab])))
    for r in out.itertuples():
        h, lang = info[r.doc_id]
        ph = (host[h][0] - own[r.doc_id] + s1 * p0) / (host[h][1] - 1 + s1)
        pp = (path[h, lang][0] - own[r.doc_id] + s2 * ph) / (path[h, lang][1] - 1 + s2)
        c = min(1 - 1e-3, max(1e-3, pp))
        post = 1 / (1 + np.exp(-(r.evidence + np.log(c / (1 - c)) - np.log(prior / (1 - prior)))))
        assert abs(r.p_host - ph) < 1e-9 and abs(r.p_path - pp) < 1e-9 and abs(r.posterior - post) < 1e-9
        assert r.kept == (r.posterior >= 0.5)


def test_pack_brute():
    """Every item goes where the dot product with what is left is highest, larger items first; against plain loops."""
    rng = np.random.default_rng(3)
    v = rng.integers(1, 50, (120, 3)).astype(float)
    items = [[k] for k in range(100)] + [list(range(100, 110)), list(range(110, 120))]
    got = sharding.pack(v, items, 8)
    total = v.sum(0)
    sums = [[sum(v[i][d] for i in ids) / (total[d] / 8) for d in range(3)] for ids in items]
    left = [[1.0] * 3 for _ in range(8)]
    want = [0] * 120
    for k in sorted(range(len(items)), key=lambda k: (-max(sums[k]), k)):
        fit = [sum(a * b for a, b in zip(r, sums[k])) for r in left]
        s = max(range(8), key=lambda j: (fit[j], -j))
        left[s] = [a - b for a, b in zip(left[s], sums[k])]
        for i in items[k]:
            want[i] = s
    assert got.tolist() == want
    loads = np.array([v[got == s].sum(0) for s in range(8)])
    assert (loads.max(0) - loads.min(0) < 0.15 * loads.mean(0)).all()


def test_mixing_rows_of_one_doc_id(spark):
    """Rows that share a doc_id but not a text, equal rows, and blocks that end inside documents."""
    rng = random.Random(12)
    data = [(k % 7, " ".join(f"w{k}_{j}" for j in range(rng.randrange(1, 60))), f"s{k % 2}") for k in range(60)]
    data += [(99, "same words here", "s0")] * 5 + [(3, None, "s1"), (4, "", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    for block_docs in (8, 0.05):
        kw = {"seats_per_source": 40, "block_docs": block_docs}
        plan = mixing.plan_mix(d, **kw)[0].drop("src").toPandas()
        mixed = mixing.mix_documents(d, **kw).toPandas()
        assert sum(len(words(t)) for t in mixed.text) == plan.taken.sum()
        assert (plan.shard_words.map(sum) == plan.taken).all() and (plan.taken <= 2 * plan["size"]).all()
        taken = Counter()
        for t in mixed.text:
            taken.update(words(t))
        assert max(v for k, v in taken.items() if "_" in k) <= 2
        assert rows(mixed) == rows(mixing.mix_documents(d.repartition(4), **kw).toPandas())


def test_mixing_quotas_reach_shards(spark):
    d = make(spark, ["w " * (5 + k % 40) for k in range(500)], {k: f"s{k % 3}" for k in range(500)})
    docs, plan, chosen = mixing.plan_mix(d, block_docs=2)
    docs, plan, chosen = docs.select("doc_id", "shard_words", "taken").toPandas(), plan.toPandas(), chosen.toPandas()
    quota = {r.src["name"]: np.diff([0, *r.seats]) for r in plan.itertuples()}
    for name, g in chosen.groupby(chosen.src.map(lambda s: s["name"])):
        got = g.groupby("shard").size().reindex(range(8), fill_value=0).to_numpy()
        assert np.abs(got[:7] - quota[name][:7]).max() == 0 and abs(got[7] - quota[name][7]) <= 2
        assert g.no.value_counts().max() <= 2 and g.sort_values("pick").no.tolist() != sorted(g.no)
    by_shard = np.sum(docs.shard_words.tolist(), 0)
    assert by_shard.tolist() == chosen.groupby("shard").words.sum().reindex(range(8), fill_value=0).tolist()


def test_pieces_windows_stay_small_and_memo_turns_over(monkeypatch):
    e = sentence_pieces.Encoder()
    rng = random.Random(3)
    text = "".join(rng.choice("abeht insor.,\n") for _ in range(1_500_000))
    assert e.decode(e.encode(text)) == text and e.streams.widest <= 2 * sentence_pieces.WINDOW
    one_word = "".join(rng.choice("abehtinsor") for _ in range(200_000))  # no word ends in it
    assert e.decode(e.encode(one_word)) == one_word and e.streams.widest <= 2 * sentence_pieces.WINDOW
    monkeypatch.setattr(sentence_pieces, "MEMO", 50)
    monkeypatch.setattr(sentence_pieces, "BLOCK", 300)
    small = sentence_pieces.Encoder()
    texts = ["".join(rng.choice("abeht in.,\n$é▁語") for _ in range(rng.randrange(2000))) for _ in range(30)] + ["語" * 700, "\U0001f600" * 400]
    for t in texts + texts:
        assert list(small.encode(t)) == list(e.encode(t)) and small.decode(small.encode(t)) == t
        assert len(small.memo) < 1500


def test_pieces_words_go_in_small_steps_and_a_worker_keeps_its_encoder(monkeypatch, tmp_path):
    """Many new words take steps of bounded size, each with the ids it has alone; a process loads a model file once, until it changes."""
    e, rng, steps = sentence_pieces.Encoder(), random.Random(4), []
    some = ["▁" + "".join(rng.choice("abehtin$語") for _ in range(rng.randrange(1, 14))) for _ in range(30_000)] + ["a" * sentence_pieces.WINDOW]
    advance = e.streams.advance
    monkeypatch.setattr(e.streams, "advance", lambda windows, final: steps.append(sum(map(len, windows))) or advance(windows, final))
    got = e.streams.encode(some)
    assert sum(steps) == sum(map(len, some)) and max(steps) < sentence_pieces.STEP + sentence_pieces.WINDOW
    for k in [*range(0, len(some), 500), len(some) - 1]:
        assert advance([some[k]], [True])[0] == [got[k]]
    assert e.streams.encode(["", *some[:3], ""]) == [b"", *got[:3], b""] and e.streams.encode([]) == []
    model = tmp_path / "m.model"
    raw = open(sentence_pieces.MODEL, "rb").read()
    model.write_bytes(raw)
    first = sentence_pieces.encoder(str(model))
    assert sentence_pieces.encoder(str(model)) is first and sentence_pieces.encoder(str(model), True).merges
    os.utime(model, ns=(1, 1))
    assert sentence_pieces.encoder(str(model)) is not first


def test_pieces_windows_equal_whole_viterbi():
    """Streams in windows against one plain pass over the whole text."""
    e = sentence_pieces.Encoder()
    v, rng = e.v, random.Random(21)
    for _ in range(25):
        t = v.escape("".join(rng.choice("abehtin s語") for _ in range(rng.randrange(1, 3000))))
        best, back = [0] + [-(10**15)] * len(t), [0] * (len(t) + 1)
        for b in range(1, len(t) + 1):
            for a in range(max(0, b - v.longest), b):
                s = v.scores.get(t[a:b], v.outside if b == a + 1 else None)
                if s is not None and best[a] + s > best[b]:
                    best[b], back[b] = best[a] + s, a
        cuts, at = [], len(t)
        while at:
            cuts.append((back[at], at))
            at = back[at]
        want = [i for a, b in reversed(cuts) for i in ([v.ids[t[a:b]]] if t[a:b] in v.ids else v.spell(t[a:b]))]
        assert np.frombuffer(e.streams.encode([t])[0], np.int32).tolist() == want


def test_tree_prunes_tiles_of_a_giant_family(spark, monkeypatch):
    """One family whose members drift through the vocabulary: all links are found, and most pairs of tiles are never joined."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    monkeypatch.setattr(jaccard_join, "TILE_HASHES", 640)
    words_ = [f"w{k}" for k in range(900)]
    texts = [" ".join(words_[5 * k : 5 * k + 80]) for k in range(160)]
    made = []
    pairs = jaccard_join.tile_pairs

    def seen(tiled, stored):
        out = pairs(tiled, stored)
        made.append((tiled.select("family", "tile").distinct().groupBy("family").count().toPandas()["count"].tolist(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "tile_pairs", seen)
    got = {r.doc_id: (r.n_similar, r.component_id) for r in jaccard_join.link(make(spark, texts)).collect()}
    sets = [{tuple(v[i : i + 3]) for i in range(len(v) - 2)} for v in map(str.split, texts)]
    want = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]) for j in range(160)) for i in range(160)}
    assert {k: v[0] for k, v in got.items()} == want and {v[1] for v in got.values()} == {0}
    (counts, joined), = made
    every = sum(n * (n + 1) // 2 for n in counts)
    assert max(counts) >= 10 and joined < 0.7 * every


def shuffled(spark, work):
    """Bytes that work() writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(60_000)
        found = sc.statusStore().stageList(None, False, False, spark._jvm.PythonUtils.toSeq([]).toArray(spark._jvm.scala.reflect.ClassTag.Double()), None)
        return [found.apply(k) for k in range(found.size())]

    last = max([-1, *(s.stageId() for s in stages())])
    work()
    return sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)


def test_large_family_moves_no_sets_of_others(spark, monkeypatch):
    """Boxes and tiles of a large family of short texts are made without sending the long sets of small families again."""
    rng = random.Random(8)
    w = [str(i) for i in range(80)]
    texts = [" ".join(w[:k] + [f"n{k}"] + w[k + 1 :]) for k in range(60)]
    for k in range(40):
        long = [f"{k}_{rng.randrange(10**6)}" for _ in range(5000)]
        texts += [" ".join(long), " ".join(long[:-1] + ["end"])]
    docs = make(spark, texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = []
    try:
        plain = shuffled(spark, lambda: got.append(sorted(map(tuple, jaccard_join.link(docs).collect()))))
        monkeypatch.setattr(jaccard_join, "TILE", 8)
        monkeypatch.setattr(jaccard_join, "TILE_HASHES", 640)
        tiled = shuffled(spark, lambda: got.append(sorted(map(tuple, jaccard_join.link(docs).collect()))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sets = 80 * 4998 * 8
    assert got[0] == got[1] and [r[2] for r in got[0]] == [59] * 60 + [1] * 80
    assert plain > 3 * sets and tiled - plain < 0.5 * sets


def test_shared_counts_take_three_bytes():
    """What a part tells a payload has three bytes a class, and more only for counts over 255; sums are whole."""
    rng = np.random.default_rng(3)
    own = [Counter({e: int(c) for e, c in enumerate(rng.integers(1, 4, 50))} | {7: 1000, 9: 255, 11: 256, 65000: 2}), Counter({0: 2000})]
    n = sum(own[0].values())
    low = [rng.permutation(n).astype(np.uint32), np.arange(n, n + 2000, dtype=np.uint32)]
    low[1][:1] = 0  # the second payload shares only this one
    parts = [np.array(sorted(c.elements()), np.uint16) for c in own]
    third = (np.arange(1, n, dtype=np.uint32), np.zeros(n - 1, np.uint16))  # has all of the first one's hashes but this one
    rows = pd.DataFrame({"part": 0, "pid": [1, 2, 3], "blob": [a.tobytes() + b.tobytes() for a, b in [*zip(low, parts), third]]})
    told = jaccard_join._shared(rows)
    size = {pid: sum(map(len, g)) for pid, g in told.groupby("pid")["blob"]}
    assert size[1] <= 3 * (len(own[0]) + 1000 // 255 + 1) and size[2] == 3
    m = 65001
    zero = np.zeros(m, np.int64).tobytes()
    body = np.array([m, m], np.uint32).tobytes() + 4 * zero + np.arange(m, dtype=np.uint32).tobytes() + np.zeros(m, np.uint32).tobytes()
    both = pd.concat([told[told.pid == 1], pd.DataFrame({"pid": [1], "own": True, "blob": [body]})])
    got = jaccard_join._totals(both)["shared"]
    assert {e: c for e, c in enumerate(got) if c} == dict(own[0])


def test_parts_stay_bounded_at_every_volume():
    for hashes in (0, 10**6, 10**9, 10**11, 10**13, 2 * 10**13):
        parts, flush = jaccard_join.shape(hashes)
        assert hashes / parts <= 2 * jaccard_join.PART[1] and flush <= jaccard_join.FLUSH[1]


def test_prefix_filter_brute_and_packed(spark):
    """Frequencies told in packed rows, over many payloads and parts, give the prefixes that whole counts give; what is sent stays
    under 8 bytes a shingle, one that all classes have goes once a payload, and rows grow with payloads, not with shingles."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64))
    sets = [np.unique(np.append(rng.choice(pool[1:], rng.integers(1, 60)), pool[:1])) for _ in range(400)] + [np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))]
    stored = common.cut(spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "cls long, hashes binary").repartition(3))
    asked = stored.mapInArrow(jaccard_join._asked(7, 1500), "part long, pid long, blob binary").cache()
    own = stored.mapInArrow(jaccard_join._asked(0, 1500), "part long, pid long, blob binary")
    told = asked.groupBy("part").applyInPandas(jaccard_join._frequencies, "pid long, part long, blob binary").unionByName(own)
    got: dict = {}
    for r in told.groupBy("pid").applyInPandas(jaccard_join._prefixes(7), "h long, cls long").collect():
        got.setdefault(r.cls, set()).add(r.h % 2**64)
    df = Counter(int(h) for x in sets for h in x)
    for k, x in enumerate(sets):
        n, order = len(x), sorted(map(int, x), key=lambda h: (df[h], h))
        first = order[: n - -(-7 * n // 10) + 1]
        assert got.get(k, set()) == {h for h in first if df[h] > 1}
    sent = asked.toPandas()
    payloads, total = sent.pid.nunique(), sum(map(len, sets))
    assert payloads > 5 and len(sent) <= 7 * payloads and sent.blob.map(len).sum() < 8 * total
    asked.unpersist()
