"""Toxicity: severity grades by cumulative-link ordinal regression.

Labels say only whether a text is toxic. Severity is graded from the labelled
toxic rows themselves: features with strong log-odds for toxic rows are found
first, and a toxic row's grade is 1, 2 or 3 as its number of them lies in the
lowest, middle or highest third among toxic rows; other rows have grade 0. One set of weights over the texts' words and
shapes then has ordered thresholds (see ordinal), and the expected severity is
the sum of the tail probabilities.

A null text has no features, and so the severity of a text without any. Labels
that are null or that name no document are left out; without any labels all
texts have the same severity. Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assocframe.llm import ordinal

GRADES = 4
SAMPLE = ordinal.SAMPLE


def severity_grades(keys: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    terms = ordinal.strong_terms(keys, at, toxic > 0)
    hits = np.bincount(np.repeat(np.arange(len(toxic)), np.diff(at)), np.isin(keys, terms).astype(float), len(toxic))
    if not (toxic > 0).any():
        return np.zeros(len(toxic), int)
    low, high = np.quantile(hits[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + (hits > low).astype(int) + (hits > high), 0).astype(int)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE, **options) -> ordinal.Model:
    keys, vals, at, toxic, _ = ordinal.collect_sample(ordinal.sample_rows(docs, labels, text, label, sample), text, share=False)
    return ordinal.fit(keys, vals, at, severity_grades(keys, at, toxic), GRADES, share=False, **options)


def score(docs: DataFrame, model: ordinal.Model, text: str = "text", cut: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (that the grade is 1 or more)
    and toxic (p_toxic >= cut) of every row."""
    found = ordinal.predict(docs, model, text)
    return found.select("doc_id", F.col("expected").alias("severity"), F.col("tails")[0].alias("p_toxic"), (F.col("tails")[0] >= cut).alias("toxic"))
