"""Operator 3: quality classifier, naive Bayes support vectors.

Indicators of word and character n-grams are scaled by class log-count ratios and a linear hinge-loss
model is fitted to them by dual coordinate descent. Labels are learnt only from rows outside the
held-out fifth (crc32 of doc_id as text, modulo 5, is 0); a score reads the text alone.

Defined results: null and empty texts have no n-gram and score what the bias says; repeated rows get a
row each; an empty table gives an empty result; without both classes the score is the only class (1 if
there is none). A null doc_id is not held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from . import textbytes as tb
from .common import by_texts, labelled_sample, table

#: The model learns from at most this many labelled rows of each class (whole texts).
SAMPLE_PER_CLASS = 1500
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> features.NbSvm:
    return features.NbSvm.fit(*labelled_sample(docs, labels, "quality", per_class, where=lambda c: ~held_out(c)))


def score(docs: DataFrame, model: features.NbSvm, keep: list[str], text: str = "text") -> DataFrame:
    def work():
        own, flags = model.ready() if model.constant is None else model, np.zeros(1 << model.bits, bool)

        def of(texts: tb.Texts, n: int) -> dict:
            words = texts.words(tb.NON_SPACE)
            groups = features.hashed(texts, words, tb.word_hashes(texts.data, words), own.bits)
            return {"score": own.probability(groups, flags)}

        return of

    return by_texts(docs, keep, text, "score double", work)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
