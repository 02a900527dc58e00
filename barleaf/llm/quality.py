"""Document quality by hierarchical empirical Bayes.

1. *Evidence.* A logistic regression over counts of letters, words and lines
   gives each document a log-likelihood ratio of good to bad. It is trained on
   up to ``TRAIN`` labelled documents, chosen by a hash of the key; that bound
   is a parameter.
2. *Sites.* A document's source, less a scheme like ``https://``, is its host (up
   to the first slash) and path (the next part; the language where there is
   none). Grouped aggregates of the
   documents' probabilities give each host a rate that is shrunk toward the
   rate of all, and each path one that is shrunk toward its host's. How much is
   estimated from the spread of the rates (beta-binomial, method of moments), so
   sparse sites fall back on what is above them.
3. *Posterior.* The path's rate without the document's own part is its prior;
   prior and evidence make the posterior, and documents at 0.5 or more are kept.

Defined results: null and empty texts have no evidence for them and are judged
as texts without letters are; a null source is a host of its own; without
labels of both kinds every document gets the labels' rate (1 without labels);
null keys and repeated rows pass through, one row per input row; an empty table
gives an empty result. A key counts once in training, however often its rows or
labels are repeated: with the mean of its labels (good from above one half) and,
if its rows differ, the text with the smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import materialize, pick
from barleaf.llm.shingles import word_hashes

TRAIN, RIDGE, STEPS = 4000, 1.0, 25
EPS = 1e-4
#: How many documents' worth a rate above counts: between these.
LEAST_WEIGHT, MOST_WEIGHT = 5.0, 1e4
FEATURES = 128 + 10


def features(text: str | None) -> np.ndarray:
    """Roots of the shares of ASCII characters and of the others; lengths; repetition of words and lines."""
    raw = (text or "").encode()
    out = np.zeros(FEATURES)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    out[:128] = np.sqrt(counts[:128] / len(raw))
    out[128] = np.sqrt(counts[128:].sum() / len(raw))
    words, _ = word_hashes(raw)
    n = len(words)
    out[129] = np.log1p(n)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    out[130] = upper / max(1, upper + lower)
    if n:
        out[131] = np.log(len(raw) / n)
        out[132] = len(np.unique(words)) / n
        out[133] = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
        out[134] = np.log1p(counts[10]) / np.log1p(n)
        out[135] = 1 - (upper + lower + counts[128:].sum()) / len(raw)
        out[136] = len(set(lines := raw.split(b"\n"))) / len(lines)
        out[137] = min(1.0, 10 / n)
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float, rate: float):
        self.mean, self.scale, self.weight, self.bias, self.rate = mean, scale, weight, bias, rate

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio: the regression's log-odds less those of the training rate."""
        if not len(self.weight):
            return np.zeros(len(x))
        odds = np.log(self.rate / (1 - self.rate))
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias - odds, -30, 30)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps; without both classes, only their rate."""
    rate = float(y.mean()) if len(y) else 1 - EPS
    if not len(y) or rate in (0.0, 1.0):
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, min(1 - EPS, max(EPS, rate)))
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.diag([RIDGE] * (z.shape[1] - 1) + [1e-6])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w[:-1], float(w[-1]), rate)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model:
    """The model, from at most ``most`` labelled documents."""
    known = pick(labels, doc_id="long", quality="double").where("doc_id is not null and quality is not null")
    chosen = known.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``most`` rows of two numbers: bounded by the parameter, so it may be broadcast
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"), F.first("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("quality")], ["doc_id", "x", "y"])

    # at most ``most`` rows, in an order of their own so that sums come out alike
    found = one.select("doc_id", "first.text", "quality").mapInArrow(run, "doc_id long, x array<double>, y double").orderBy("doc_id").toArrow()
    x = np.array(found.column("x").to_pylist(), "f8").reshape(-1, FEATURES)
    return fit(x, (found.column("y").to_numpy() > 0.5).astype("f8"))


def with_evidence(docs: DataFrame, model: Model, columns: dict[str, str]) -> DataFrame:
    """The wanted columns of ``docs``, with ``llr`` added."""
    schema = ", ".join([*(f"{n} {t}" for n, t in columns.items()), "llr double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.ratio(x))], [*batch.schema.names, "llr"])

    return pick(docs, **columns).mapInArrow(run, schema)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.ln(p / (F.lit(1.0) - p))


def weight(groups: DataFrame, above: Column) -> float:
    """How many documents the rate above counts for, by the spread of the groups' rates around it."""
    noise = above * (1 - above) / F.col("n")
    spread = F.avg(F.pow(F.col("s") / F.col("n") - above, 2) - noise)
    mean = F.avg(above * (1 - above))
    k = mean / F.greatest(spread, F.lit(1e-9)) - 1
    return float(groups.agg(F.coalesce(F.least(F.greatest(k, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)), F.lit(MOST_WEIGHT))).first()[0])


def site_rates(evidence: DataFrame, rate: float) -> DataFrame:
    """host, path, sp, np (own sum and number), above (the host's shrunk rate), kp (its weight).

    evidence: host, path, llr. Two grouped aggregates; the second adds up the first.
    """
    p = sigmoid(F.col("llr") + F.lit(float(np.log(rate / (1 - rate)))))
    paths = materialize(evidence.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total, every = hosts.agg(F.sum("s"), F.sum("n")).first()
    mu = F.lit(float(total) / every if every else rate)
    kh = weight(hosts, mu)
    hosts = hosts.select("host", ((F.col("s") + kh * mu) / (F.col("n") + kh)).alias("above"))
    both = materialize(paths.join(hosts, "host"), "sites")
    kp = weight(both, F.col("above"))
    return both.select("host", "path", F.col("s").alias("sp"), F.col("n").alias("np"), "above", F.lit(kp).alias("kp"))


def site_columns(df: DataFrame) -> DataFrame:
    """Adds host and path, never null and never mixing null with text."""
    parts = F.split(F.regexp_replace("source", "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "/")
    host = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.get(parts, F.lit(0))))
    path = F.get(parts, F.lit(1))
    return df.withColumns({"host": host, "path": F.coalesce(F.concat(F.lit("p"), path), F.concat(F.lit("l"), F.col("lang")), F.lit("n"))})


def posterior(rows: DataFrame, model: Model) -> DataFrame:
    """rows (host, path, llr and any others) with prior, quality and keep added."""
    sites = materialize(site_rates(rows.select("host", "path", "llr"), model.rate), "rates")
    own = sigmoid(F.col("llr") + F.lit(float(np.log(model.rate / (1 - model.rate)))))
    prior = (F.col("sp") - own + F.col("kp") * F.col("above")) / (F.col("np") - 1 + F.col("kp"))
    out = rows.join(sites, ["host", "path"]).withColumn("prior", prior)
    return out.withColumn("quality", sigmoid(F.col("llr") + logit(F.col("prior")))).withColumn("keep", F.col("quality") >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """Per document the evidence (llr), its site's prior, the posterior (quality) and whether it is kept.

    keep: columns of ``docs`` to return besides; doc_id and source if None.
    """
    model = train(docs, labels)
    wanted = {"doc_id": "long", "source": "string"} if keep is None else keep
    rows = with_evidence(docs, model, wanted | {"text": "string", "lang": "string", "source": "string"})
    rows = site_columns(rows).select(*wanted, "host", "path", "llr")
    return posterior(materialize(rows, "evidence"), model).select(*wanted, "llr", "prior", "quality", "keep")
