"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over form features (trained on at most TRAIN labelled rows, those with the smallest seeded
hashes) gives each document's evidence. Hosts (source) and paths (source, lang) get posteriors from grouped sums
of labels, and of classifier probabilities where there is no label: a path is shrunk toward its host and a host
toward the corpus, with prior strengths from the between-group variance (method of moments of the beta binomial),
so a sparse site says little. A document's own share is taken out of its site's sums before they judge it.

Hot hosts are summed before the shuffle, and their posterior comes back by a join that is safe for hot keys.

Cases: null and empty texts have zero features; null source or lang is a site of its own; several labels of one
document count as their smallest quality; without labels of both classes the classifier is neutral; equal rows get
equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, per_batch, table
from .common import sample as sample_rows
from .quality_rules import measure

TRAIN, RIDGE, SEED, THRESHOLD = 20000, 1.0, 11, 0.5
FEATURES = ("log_words", "symbols", "dup_lines", "repeats", "stutter", "word_len", "digits", "upper", "stops", "line_len", "variety")
_DIGITS, _UPPER = re.compile(r"[0-9]"), re.compile(r"[A-Z]")


def features(text: str | None) -> list[float]:
    text = text or ""
    words, chars, symbols, lines, dup, rep, adj = measure(text)
    n = max(1, words)
    c = max(1, chars)
    return [np.log1p(words), min(3.0, symbols / n), dup / max(1, lines), rep / n, adj / n, min(20.0, chars / n), len(_DIGITS.findall(text)) / c, len(_UPPER.findall(text)) / c, text.count(".") / n, np.log1p(words / max(1, lines)), len(set(text.split())) / n]


def _featurise(b: pa.RecordBatch):
    rows = [features(t) for t in b.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *[pa.array(x, pa.float64()) for x in zip(*rows)]], ["doc_id", "host", "path", *FEATURES])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights on raw features and intercept of a ridge logistic regression, by Newton steps."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    pen = np.eye(a.shape[1]) * ridge
    pen[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    coef = w[:-1] / sd
    return coef, float(w[-1] - coef @ mean)


def strength(groups: DataFrame, k: str, n: str, mean) -> float:
    """Prior strength (pseudo rows) from the spread of group rates around their means; one aggregation."""
    r = groups.agg(F.sum(F.pow(F.col(k) - F.col(n) * mean, 2) / (F.col(n) * F.greatest(mean * (1 - mean), F.lit(1e-9)))).alias("s"), F.count("*").alias("h"), F.sum(n).alias("m"), F.sum(F.col(n) * F.col(n)).alias("m2")).first()
    if not r["h"] or r["h"] < 2:
        return 1e4
    rho = ((r["s"] or 0.0) - (r["h"] - 1)) / max(1e-9, r["m"] - r["m2"] / r["m"] - (r["h"] - 1))
    rho = min(0.99, max(1e-4, rho))
    return (1 - rho) / rho


def classify(docs: DataFrame, labels: DataFrame, train: int = TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence (log odds), p_document, p_host, p_path, posterior, kept."""
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    f = cut(per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", site("source").alias("host"), site("lang").alias("path")), _featurise, "doc_id long, host string, path string, " + ", ".join(f"{x} double" for x in FEATURES)))
    y = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("y"))
    f = f.join(y, "doc_id", "left")
    sample = sample_rows(f.where("y is not null"), "doc_id", train, SEED).select(*FEATURES, "y").toPandas()
    if len(sample) and 0 < sample["y"].mean() < 1:
        coef, bias = fit(sample[list(FEATURES)].to_numpy(), sample["y"].to_numpy())
        prior = float(np.clip(sample["y"].mean(), 1e-3, 1 - 1e-3))
    else:
        coef, bias, prior = np.zeros(len(FEATURES)), 0.0, 0.5
    logit = F.lit(bias)
    for c, w in zip(FEATURES, coef):
        logit = logit + F.col(c) * float(w)
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))
    s = cut(f.select("doc_id", "host", "path", "y", logit.alias("evidence")).withColumn("p_document", 1 / (1 + F.exp(-F.col("evidence")))).withColumn("own", F.coalesce("y", "p_document")))
    paths = cut(s.groupBy("host", "path").agg(F.sum("own").alias("k"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    k, n = hosts.agg(F.coalesce(F.sum("hk"), F.lit(0.0)), F.coalesce(F.sum("hn"), F.lit(0))).first()
    p0 = min(1 - 1e-3, max(1e-3, k / n)) if n else 0.5
    s1 = strength(hosts, "hk", "hn", F.lit(p0))
    hosts = hosts.withColumn("mean", (F.col("hk") + s1 * p0) / (F.col("hn") + s1))
    facts = cut(paths.join(hosts, "host"))
    s2 = strength(facts, "k", "n", F.col("mean"))
    facts = facts.select("host", "path", "k", "n", "hk", "hn")
    j = attach(s, facts, ["host", "path"], "n", F.col("doc_id"))
    p_host = (F.col("hk") - F.col("own") + s1 * p0) / (F.col("hn") - 1 + s1)
    j = j.withColumn("p_host", p_host).withColumn("p_path", (F.col("k") - F.col("own") + s2 * F.col("p_host")) / (F.col("n") - 1 + s2))
    c = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("p_path")))
    post = 1 / (1 + F.exp(-(F.col("evidence") + F.log(c / (1 - c)) - float(np.log(prior / (1 - prior))))))
    return j.withColumn("posterior", post).select("doc_id", "evidence", "p_document", "p_host", "p_path", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
