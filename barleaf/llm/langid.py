"""Language by multilingual mixtures.

Each language has a smoothed multinomial over character trigrams of its words
(with word ends). A document is a mixture: each word comes from one language,
and expectation-maximisation finds the languages' shares, until they come to
rest. The set of languages
grows from the best single one, by their shares among all, up to all learned
languages; of these sets it is the one with the largest likelihood, less half
the logarithm of the number of words and the logarithm of the number of
languages for each language added. A document is left when even a perfect fit
could not make up for one more. The prediction is the language with the largest
share in that set.

Counts are learned from a sample of labelled documents: all of a language that
has up to ``PER_LANGUAGE`` of them, else about so many, chosen by a hash of the
key. That bound is a parameter; predictions read whole texts.

Defined results: a null text or one without letters is ``und`` with score 0,
and so is every text if nothing was learned; rows with a null key are never
learned from and not held out; repeated rows get one row each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import pick
from barleaf.llm.tokenstore import mix

PER_LANGUAGE, FOLDS, HELD_OUT = 1000, 4, 2
ALPHABET = 64
#: EM goes on until no share moves by more than this, MOST_ROUNDS at most; after each ROUNDS, texts that have come to rest are left out.
REST, ROUNDS, MOST_ROUNDS = 1e-4, 8, 400
#: Characters that are scored at once, for one language.
CHUNK = 4 << 20
SMOOTH = 0.1
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, mixture string"


@cache
def letter_classes() -> np.ndarray:
    """Code point -> 0 for all but letters, 1-26 for a-z, 27-63 by hash for others."""
    points = np.arange(0x110000, dtype="u8")
    out = (27 + mix(points, 11) % np.uint64(ALPHABET - 27)).astype("u1")
    out[~np.array([chr(i).isalpha() for i in range(0x110000)])] = 0
    out[97:123] = np.arange(1, 27)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram around each letter; where words start among these; the text of each word."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    c = letter_classes()[points].astype("i4")
    at = np.flatnonzero(c)
    gram = c[at - 1] * ALPHABET**2 + c[at] * ALPHABET + c[at + 1] if len(at) else at.astype("i4")
    starts = np.flatnonzero(c[at - 1] == 0)
    ends = np.cumsum([1 + len(t) for t in lower])
    return gram, starts, np.searchsorted(ends, at[starts] - 1, side="right")


def fold_of(key: str):
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % FOLDS


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each trigram under each."""
    rows = pick(docs, doc_id="long", text="string", lang="string").where((fold_of("doc_id") != HELD_OUT) & F.col("lang").isNotNull())
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(have)
    if not names:
        return [], np.zeros((ALPHABET**3, 0), "f4")
    share = F.create_map(*(F.lit(x) for name in names for x in (name, min(1.0, per_language / have[name]))))
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)
    sample = rows.where(uniform < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(ALPHABET**3, "i8") for name in names}
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                np.add.at(sums[name], grams([text or ""])[0], 1)
        for name, n in sums.items():
            if len(at := np.flatnonzero(n)):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(n[at])], ["lang", "gram", "n"])

    counts = np.full((ALPHABET**3, len(names)), SMOOTH)
    # at most one row for each language and trigram
    for r in sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.gram, names.index(r.lang)] += r.n
    return names, np.log(counts / counts.sum(0)).astype("f4")


def em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages allowed (where ``share`` is above 0), and the log-likelihood. like: by word, relative to its best."""
    share = share.copy()
    at, words, of, starts = np.arange(len(n)), like, doc, first
    for turn in range(MOST_ROUNDS):
        own = words * share[at][of]
        own /= np.maximum(own.sum(1, keepdims=True), 1e-30)
        new = np.add.reduceat(own, starts, axis=0) / n[at][:, None]
        moves = np.abs(new - share[at]).max(1) > REST
        share[at] = new
        if not moves.any():
            break
        if turn % ROUNDS == ROUNDS - 1 and not moves.all():
            words, at = words[moves[of]], at[moves]
            of = np.repeat(np.arange(len(at)), n[at])
            starts = np.cumsum(n[at]) - n[at]
    fit = np.log(np.maximum((like * share[doc]).sum(1), 1e-30))
    return share, np.add.reduceat(fit, first)


def mixtures(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The share of each language in each text, 0 for those outside its set; a row of zeros if there is no letter."""
    langs = table.shape[1]
    out = np.zeros((len(texts), langs))
    gram, starts, word_doc = grams(texts)
    if not len(starts) or not langs:
        return out
    words = np.add.reduceat(table[gram], starts, axis=0).astype("f8")
    has, first, doc, n = np.unique(word_doc, return_index=True, return_inverse=True, return_counts=True)
    top = words.max(1, keepdims=True)
    like = np.exp(words - top)
    single = np.add.reduceat(np.maximum(words - top, -69.0), first, axis=0)
    best, set_ = single.max(1), np.zeros((len(has), langs))
    set_[np.arange(len(has)), single.argmax(1)] = 1
    chosen = set_.copy()
    cost, order = 0.5 * np.log(n) + np.log(langs), np.zeros((len(has), langs), "i8")
    at = np.arange(len(has))
    for k in range(2, langs + 1):
        # no fit is above 0
        rest = best[at] < -(k - 1) * cost[at]
        if not rest.all():
            at, like = at[rest], like[rest[doc]]
            doc = np.repeat(np.arange(len(at)), n[at])
        if not len(at):
            break
        first = np.cumsum(n[at]) - n[at]
        if k == 2:
            every, _ = em(like, doc, first, n[at], np.full((len(at), langs), 1 / langs))
            order[at] = np.argsort(-(every + set_[at]), axis=1, kind="stable")
        start = np.zeros((len(at), langs))
        np.put_along_axis(start, order[at, :k], 1 / k, axis=1)
        share, fit = em(like, doc, first, n[at], start)
        fit = fit - (k - 1) * cost[at]
        better = fit > best[at]
        chosen[at[better]], best[at] = share[better], np.maximum(fit, best[at])
    out[has] = chosen
    return out


def described(names: list[str], share: np.ndarray) -> str:
    at = sorted(np.flatnonzero(share >= 0.005).tolist(), key=lambda i: (-share[i], i))
    return ",".join(f"{names[i]}:{share[i]:.2f}" for i in at)


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """Per document its held-out mark, predicted language, that language's share, and all shares."""
    model = docs.sparkSession.sparkContext.broadcast(table)  # 64**3 rows, a column for each language
    chunk = CHUNK // max(1, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            shares, a, chars = [], 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= chunk or i == len(texts) - 1:
                    shares.append(mixtures(texts[a : i + 1], model.value))
                    a, chars = i + 1, 0
            every = np.concatenate(shares) if shares else np.zeros((0, len(names)))
            known = every.sum(1) > 0 if len(names) else np.zeros(len(texts), bool)
            pred = [names[s.argmax()] if k else "und" for s, k in zip(every, known, strict=True)]
            score = [float(min(1.0, s.max())) if k else 0.0 for s, k in zip(every, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([described(names, s) for s in every], pa.string())], ["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = pick(docs, doc_id="long", text="string")
    return rows.select("doc_id", F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(docs))
