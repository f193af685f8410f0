"""Toxicity: a factorization machine over hashed terms.

A term is a word (``\\w+``, lower-cased) or the beginning of one, so that inflected words share
terms; it is hashed into ``2**hash_bits`` numbers. A text is the set of its terms. The model adds a
weight per term and, for every pair of terms, the product of their factors:

    score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>)

so two terms can be worse together than alone. The pair sum costs one pass over the terms, by
``((sum v)**2 - sum v**2) / 2``.

Fitting takes about ``sample_rows`` labelled rows and has two steps, because most terms of a text say
nothing and would only be learnt by heart:

1. Spark counts the terms of the sample by label and keeps the ``n_terms`` with the largest
   likelihood ratio, of those above ``min_ratio``, which few terms reach by chance. A machine is
   fitted to them.
2. What it leaves unexplained is summed for every pair of the ``pair_words`` most frequent words.
   A pair whose sum is ``min_pair_z`` standard deviations from nothing brings in both its words,
   whatever they say alone, up to ``n_pair_terms``. The machine is fitted anew to all terms kept.

Only the sample's terms among these reach the driver. Scoring adds a column to any table, without a
shuffle.

Cases: a null or empty text has no terms and gets the score of the bias; unlabelled rows, null
labels and null ids are not used to fit; without labels of both kinds every score is that of the
known share; repeated rows are scored each; a column named ``score`` is replaced, other columns
pass through.
"""

from __future__ import annotations

import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import labelled_sample, worker_store

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

PREFIXES = (4, 5)
WORD = re.compile(r"\w+")
PART_CHARS = 1 << 20
KNOWN_WORDS = 400_000


def words(text: str) -> set[str]:
    """The different words of a text, read in parts of bounded length."""
    found: set[str] = set()
    start, lower = 0, text.lower()
    while start < len(lower):
        end = start + PART_CHARS
        while end < len(lower) and (lower[end].isalnum() or lower[end] == "_"):
            end += 1
        found.update(WORD.findall(lower, start, end))
        start = end
    return found


def terms(word: str, hash_bits: int) -> list[int]:
    """Hashed terms of one word: itself and its beginnings."""
    mask = (1 << hash_bits) - 1
    parts = [f"{word}$"] + [word[:k] for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(p.encode()) & mask for p in parts]


@dataclass
class FactorMachine:
    hash_bits: int
    position: dict[int, int]  # hashed term: column
    weight: np.ndarray  # float64 [columns]
    factor: np.ndarray  # float64 [columns, factors]
    bias: float

    def columns(self, text: str, known: dict) -> np.ndarray:
        """Columns of a text; ``known`` remembers those of words, up to a bound."""
        found: set[int] = set()
        for word in words(text):
            own = known.get(word)
            if own is None:
                own = [c for t in terms(word, self.hash_bits) if (c := self.position.get(t, -1)) >= 0]
                if len(known) < KNOWN_WORDS and len(word) <= 32:
                    known[word] = own
            found.update(own)
        return np.array(sorted(found), np.int64)

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        return margins(rows, self.weight, self.factor, self.bias)[0]


def margins(rows, weight, factor, bias):
    """Margins of rows of columns, the sums of their factors, and the flat columns and owners."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    linear = np.bincount(owner, weight[flat], len(rows))
    sums = np.stack(
        [np.bincount(owner, factor[flat, k], len(rows)) for k in range(factor.shape[1])], axis=1
    )
    squares = np.bincount(owner, (factor[flat] ** 2).sum(axis=1), len(rows))
    return bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums, flat, owner


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(
    rows: list[np.ndarray],
    y: np.ndarray,
    n_columns: int,
    factors: int = 8,
    epochs: int = 30,
    batch: int = 256,
    rate: float = 0.1,
    penalty: float = 1e-4,
    seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias by adaptive-step gradient descent on the logistic loss."""
    r = np.random.default_rng(seed)
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    weight, factor = np.zeros(n_columns), r.normal(0, 0.01, (n_columns, factors))
    if not len(y) or y.min() == y.max():
        return weight, factor * 0, bias
    # The bias stays: a text without known terms gets the share of label 1.
    weight_sum, factor_sum = np.full(n_columns, 1e-6), np.full((n_columns, factors), 1e-6)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            take = order[at : at + batch]
            margin, sums, flat, owner = margins([rows[i] for i in take], weight, factor, bias)
            if not len(flat):
                continue
            error = (sigmoid(margin) - y[take]) / len(take)
            used, place = np.unique(flat, return_inverse=True)
            step = error[owner]
            gw = np.bincount(place, step, len(used)) + penalty * weight[used]
            each = step[:, None] * (sums[owner] - factor[flat])
            gv = np.stack(
                [np.bincount(place, each[:, k], len(used)) for k in range(factors)], axis=1
            )
            gv += penalty * factor[used]
            weight_sum[used] += gw**2
            factor_sum[used] += gv**2
            weight[used] -= rate * gw / np.sqrt(weight_sum[used])
            factor[used] -= 0.3 * rate * gv / np.sqrt(factor_sum[used])
    return weight, factor, bias


PAIR_BLOCK = 2_000


def pair_terms(
    rows: list[np.ndarray], y: np.ndarray, chance: np.ndarray, words: np.ndarray, min_z: float, limit: int
) -> list[int]:
    """The columns among ``words`` of the pairs whose rows are not what ``chance`` says, surest pair first.

    A pair's rows together have ``sum(y - chance)`` more of label 1 than expected, with the variance
    ``sum(chance * (1 - chance))``; one is added, so that a few rows prove nothing.
    """
    place = np.full(int(max(words, default=-1)) + 1, -1)
    place[words] = np.arange(len(words))
    surplus = np.zeros((len(words), len(words)), np.float32)
    variance = np.ones_like(surplus)
    error, spread = (y - chance).astype(np.float32), (chance * (1 - chance)).astype(np.float32)
    for at in range(0, len(rows), PAIR_BLOCK):
        part = range(at, min(at + PAIR_BLOCK, len(rows)))
        present = np.zeros((len(part), len(words)), np.float32)
        for i in part:
            here = place[rows[i][rows[i] < len(place)]]
            present[i - at, here[here >= 0]] = 1
        surplus += present.T @ (present * error[part, None])
        variance += present.T @ (present * spread[part, None])
    z = np.triu(np.abs(surplus) / np.sqrt(variance), 1)
    first, second = np.nonzero(z >= min_z)
    # so many pairs have at least ``limit`` different words
    best = np.argsort(-z[first, second], kind="stable")[: limit * limit]
    found = np.stack([words[first[best]], words[second[best]]], axis=1).ravel()
    return list(dict.fromkeys(found.tolist()))[:limit]


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample_rows: int = 20_000,
    n_terms: int = 2_000,
    min_rows: int = 3,
    min_ratio: float = 15.0,
    pair_words: int = 3_000,
    min_pair_z: float = 5.5,
    n_pair_terms: int = 500,
    hash_bits: int = 22,
) -> FactorMachine:
    """A model from ``labels(doc_id, <label>)``; ``sample_rows`` bounds what is fitted."""

    @F.pandas_udf("words array<int>, parts array<int>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        each = [[terms(w, hash_bits) for w in words(x or "")] for x in texts]
        whole = [sorted({t[0] for t in x}) for x in each]
        parts = [sorted({t for w in x for t in w[1:]} - set(y)) for x, y in zip(each, whole)]
        return pd.DataFrame({"words": whole, "parts": parts})

    sample = labelled_sample(docs, labels, label, sample_rows)
    sample = sample.select("label", hashed("text").alias("found")).select(
        "label", "found.words", F.concat("found.words", "found.parts").alias("terms")
    )
    sample = storage.keep(sample, "toxic_sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).head()
    n, bad = totals["n"], totals["bad"] or 0.0

    def part(seen, among, of, total):
        """seen * log(seen / expected), nothing for none."""
        return F.when(seen > 0, seen * F.log(seen * total / (among * of))).otherwise(0.0)

    with_term, of_bad = F.col("rows"), F.col("bad")
    ratio = (
        part(of_bad, with_term, F.lit(float(bad)), n)
        + part(with_term - of_bad, with_term, F.lit(float(n - bad)), n)
        + part(bad - of_bad, n - with_term, F.lit(float(bad)), n)
        + part(n - bad - with_term + of_bad, n - with_term, F.lit(float(n - bad)), n)
    )
    best = (
        sample.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("label").alias("bad"))
        .where(F.col("rows") >= min_rows)
        .where(2 * ratio >= min_ratio)
        .orderBy(ratio.desc(), "term")
        .limit(n_terms)
    )
    often = (
        sample.select(F.explode("words").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= min_rows)
        .orderBy(F.desc("rows"), "term")
        .limit(pair_words)
    )
    alone = [r["term"] for r in best.select("term").collect()]
    frequent = [r["term"] for r in often.select("term").collect()]
    position = {t: i for i, t in enumerate(dict.fromkeys([*alone, *frequent]))}

    @F.pandas_udf("array<int>")
    def among(found: pd.Series) -> pd.Series:
        return pd.Series([sorted(position[t] for t in x.tolist() if t in position) for x in found])

    few = sample.select("label", among("terms").alias("terms")).toPandas()
    rows = [np.array(x, np.int64) for x in few["terms"]]
    # A fixed order, whatever order the rows arrive in.
    order = sorted(range(len(rows)), key=lambda i: (few["label"][i], rows[i].tolist()))
    y = few["label"].to_numpy(np.float64)[order]
    rows = [rows[i] for i in order]
    single = [r[r < len(alone)] for r in rows]
    weight, factor, bias = fit(single, y, len(alone))
    kept = list(range(len(alone)))
    if len(y) and y.min() < y.max():
        chance = sigmoid(margins(single, weight, factor, bias)[0])
        candidates = np.array([position[t] for t in frequent], np.int64)
        pairs = pair_terms(rows, y, chance, candidates, min_pair_z, n_pair_terms)
        added = [c for c in pairs if c >= len(alone)]
        if pairs:
            kept += added
            column = np.full(len(position), -1)
            column[kept] = np.arange(len(kept))
            rows = [c[c >= 0] for c in (column[r] for r in rows)]
            weight, factor, bias = fit(rows, y, len(kept))
    by_position = list(position)
    return FactorMachine(hash_bits, {by_position[c]: i for i, c in enumerate(kept)}, weight, factor, bias)


def score(docs: DataFrame, model: FactorMachine) -> DataFrame:
    """``docs`` with ``score``, the probability of the label."""
    key = ("toxic_words", zlib.crc32(model.weight.tobytes() + model.factor.tobytes()))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        store = worker_store()
        if key not in store:
            for old in [k for k in store if k[0] == key[0]]:
                del store[old]
            store[key] = {}
        rows = [model.columns(t or "", store[key]) for t in texts]
        return pd.Series(sigmoid(model.margin(rows)))

    return docs.withColumn("score", scored("text"))
