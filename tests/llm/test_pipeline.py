"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline as c
import duckdb
import pytest
from test_operators import brute_runs

from palimpsest.llm import jaccard_join, quality_rules

SF = "/root/testdata/sf0.001"


def without_empty(texts):
    return {i: t for i, t in texts.items() if t and t.split()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.toPandas())
        if k < 4:
            assert docs.columns == list(c.COLUMNS)
    first = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()
    want = {r.doc_id: r.text for r in first.itertuples() if not quality_rules.failed_bits(*quality_rules.measure(r.text))}
    assert {r.doc_id: r.text for r in kept[0].itertuples()} == want
    # line dedup: every repeated run of lines, by comparing lines, no hashes and no chunks
    ids = sorted(want)
    texts = without_empty(dict(zip(ids, brute_runs([want[i] for i in ids]))))
    assert {r.doc_id: r.text for r in kept[1].itertuples()} == texts and texts != want
    memo: dict = {}
    sets = {i: set(jaccard_join.shingles(t, memo).tolist()) for i, t in texts.items()}
    comp = {i: i for i in sets}
    for _ in range(10):
        for i in sets:
            for j in sets:
                if i < j and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert sorted(kept[2].doc_id) == sorted(i for i, r in comp.items() if i == r)
    left = {r.doc_id: r.text.split() for r in kept[2].itertuples()}
    words: dict = {}
    for r in kept[3].itertuples():
        words.setdefault(r.doc_id, []).extend(r.text.split())
    assert all(len(w) <= 2 * len(left[i]) and set(w) <= set(left[i]) for i, w in words.items())
    assert kept[4].lossless.all() and len(kept[4]) == len(kept[3])


ODD = [None, "", " \n\t ", "one", "A" * 3000, "word " * 2000, "same text here for all\nand a second line of it", "same text here for all\nand a second line of it", "é ñ 日本 😀 x\n▁", "\x1c\x85\xa0 odd spaces"]


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_odd_rows(spark, name, stage):
    plain = "a plain text of more than twenty words that says nothing much at all but goes on until the rules are content with its length".split()
    texts = ODD + [" ".join(plain[k:] + plain[:k]) for k in range(3)]
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", len(t or ""), "x") for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows + rows[6:7] + rows[-1:], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    got = stage(spark, d, SF).toPandas()
    if name == "quality rules":
        assert sorted(got.doc_id) == [10, 11, 12, 12]
    elif name == "line dedup":
        assert sorted(got.doc_id) == [3, 4, 5, 6, 6, 8, 9, 10, 11, 12, 12]
    elif name == "n-gram Jaccard join":
        assert sorted(got.doc_id)[:7] == [0, 1, 2, 3, 4, 5, 6] and 7 not in set(got.doc_id)
    elif name == "sentence pieces":
        assert len(got) == len(rows) + 2 and got.n_tokens.isna().sum() == 1
    if name != "sentence pieces":
        assert list(got.columns) == list(c.COLUMNS)
    assert stage(spark, d.limit(0), SF).count() == 0


def test_repeated_line_runs_do_not_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality_rules.filter_documents(docs).toPandas().sort_values("doc_id")
    out = {r.doc_id: r.text.split("\n") for r in c.lines(spark, c.quality(spark, docs, SF), SF).collect()}
    seen, n = set(), 0
    for i, t in zip(kept.doc_id, kept.text):
        at = [k for k, x in enumerate(t.split("\n")) if x.split()]
        ls = t.split("\n")
        for a, b in zip(at, at[1:]):
            p = tuple(ls[a : b + 1])
            if p in seen and ls.count(ls[a]) == ls.count(ls[b]) == 1:
                n += 1
                assert not {ls[a], ls[b]} & set(out.get(i, []))
            seen.add(p)
    assert n > 50


def test_run(spark):
    assert c.run(spark, SF).count() > 0
