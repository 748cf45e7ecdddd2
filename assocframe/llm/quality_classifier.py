"""Quality classifier: cumulative-link ordinal regression on graded ratings.

A rating is 0 where the label finds the quality low, 1 where it is high but the
text is labelled toxic, and 2 where it is high and the text is not. Hashed words
and word shapes, as roots of shares of the text's words, have one set of weights; the
ratings have ordered thresholds (see ordinal). The result has the expected
grade and the tail probabilities that selection uses.

A null text has no features. Labels with a null quality, or that name no
document, are left out (a null toxic counts as not toxic); without any labels
all texts have the same grade. Repeated rows are scored each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assocframe.llm import ordinal

GRADES = 3
SAMPLE = ordinal.SAMPLE


def ratings(labels: DataFrame) -> DataFrame:
    good = F.col("quality") > 0
    return labels.where("quality is not null").select("doc_id", F.when(good & (F.coalesce("toxic", F.lit(0)) == 0), 2).when(good, 1).otherwise(0).alias("rating"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, **options) -> ordinal.Model:
    keys, vals, at, grades, _ = ordinal.collect_sample(ordinal.sample_rows(docs, ratings(labels), text, "rating", sample), text, share=True)
    return ordinal.fit(keys, vals, at, grades.astype(int), GRADES, share=True, **({"ridge": 1e-2, "z": 8.0} | options))


def score(docs: DataFrame, model: ordinal.Model, text: str = "text", cut: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good (that the grade is 1 or more), p_best
    (that it is 2) and kept (p_good >= cut) of every row."""
    found = ordinal.predict(docs, model, text)
    return found.select("doc_id", F.col("expected").alias("expected_grade"), F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_best"), (F.col("tails")[0] >= cut).alias("kept"))
