"""Quality rules: fixed base rules, then boosted trees over statistics of each whole text.

Statistics are counted per row in an Arrow-batched function; nothing is shuffled. The trees are
fitted on a bounded sample of labelled rows (about ``sample_rows``, chosen by the hash of the id,
the only rows that reach the driver) and scored as flat numpy arrays. Quality can't rise with the
share of symbols, repeated words, repeated lines or capitals (monotonic constraints).

Cases: a null or empty text has no words, is rejected by the base rules and scored like any other;
labels that are null or whose document is missing are not used, of several labels of a document
the lowest counts; without labels only the base rules decide; a null ``doc_id`` is assessed but
never used to fit; repeated rows are assessed each; columns of the documents with the names of the
results are replaced.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm import boosting, common
from chatlens.llm.common import WHITE, labelled_sample, word_parts

for _module in (sys.modules[__name__], boosting, common):
    cloudpickle.register_pickle_by_value(_module)

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: More statistics for the trees only.
SHAPES = ["n_chars", "n_lines", "n_capitals", "n_digits", "n_stops", "n_commas"]
#: Columns of the trees and their constraints.
FEATURES = [
    ("log_words", 0),
    ("mean_word", 0),
    ("symbol_share", -1),
    ("repeat_share", -1),
    ("dup_line_share", -1),
    ("capital_share", -1),
    ("digit_share", 0),
    ("words_a_line", 0),
    ("words_a_stop", 0),
    ("words_a_comma", 0),
]
WORD = re.compile(r"[^\x20\x09-\x0D]")


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of three that occur at least twice."""
    n = len(ids) - 2
    if n < 2:
        return 0
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, window, times = np.unique(
        pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True
    )
    again = times[window] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def statistics(text: str) -> list[int]:
    """``COUNTS`` and ``SHAPES`` of one text."""
    data = text.encode()
    number: dict[bytes, int] = {}
    parts = []
    for words in word_parts(data, 0):
        parts.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    ascii_counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda chars: int(sum(ascii_counts[ord(c)] for c in chars))
    return [
        len(ids),
        len(text) - count(WHITE),
        count(SYMBOLS),
        dup,
        repeated_words(ids),
        len(text),
        lines,
        int(ascii_counts[65:91].sum()),
        int(ascii_counts[48:58].sum()),
        count(".!?"),
        count(",;:"),
    ]


def features(stats: np.ndarray) -> np.ndarray:
    """The columns of ``FEATURES`` from rows of ``statistics``."""
    s = stats.astype(np.float64)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    lines = np.maximum(s[:, 6], 1)
    return np.stack(
        [
            np.log1p(s[:, 0]),
            s[:, 1] / words,
            s[:, 2] / words,
            s[:, 4] / words,
            s[:, 3] / lines,
            s[:, 7] / chars,
            s[:, 8] / chars,
            words / lines,
            words / (s[:, 9] + 1),
            words / (s[:, 10] + 1),
        ],
        axis=1,
    )


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> boosting.FlatTrees:
    """Trees from about ``sample_rows`` rows of ``labels(doc_id, quality)``."""
    names = COUNTS + SHAPES

    @F.pandas_udf("array<long>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])

    sample = labelled_sample(docs, labels, "quality", sample_rows)
    rows = sample.select(stats("text").alias("s"), "label").toPandas()
    x = np.array(rows["s"].tolist(), np.int64).reshape(-1, len(names))
    # A fixed order, whatever order the rows arrive in.
    order = np.lexsort(np.column_stack([x, rows["label"]]).T)
    y = rows["label"].to_numpy(np.float64)[order]
    return boosting.fit(features(x)[order], y, [m for _, m in FEATURES])


def assess(docs: DataFrame, model: boosting.FlatTrees, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``COUNTS``, ``base_failed``, ``quality_score`` and ``kept``.

    A text is kept if it passes the base rules and its score is at least ``threshold``.
    """
    fields = [f"{c} long" for c in COUNTS] + ["base_failed boolean, quality_score double, kept boolean"]

    @F.pandas_udf(", ".join(fields))
    def assessed(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([statistics(t or "") for t in texts], np.int64)
        rows = rows.reshape(-1, len(COUNTS) + len(SHAPES))
        out = pd.DataFrame(rows[:, : len(COUNTS)], columns=COUNTS)
        out["base_failed"] = base_failed(out["n_words"], out["n_repeat_words"])
        out["quality_score"] = model.score(features(rows))
        out["kept"] = ~out["base_failed"] & (out["quality_score"] >= threshold)
        return out

    results = [*COUNTS, "base_failed", "quality_score", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    found = docs.select(*own, assessed("text").alias("_assessed"))
    return found.select(*own, *[F.col(f"_assessed.{c}").alias(c) for c in results])


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    marked = docs.withColumn("_doc", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = assess(marked.select("text", "_doc"), train(docs, labels), threshold)
    return found.where("kept").select("_doc.*")
