"""Operator 7: quality rules.

Counted rules (few words, words repeated in 5-word windows) and a learnt one: logistic regression on
hashed word and character n-grams, trained on labelled rows, probability-calibrated on rows left out
of the fit, scored in Arrow batches against a fixed threshold.

Defined results: a null or empty text has no words, so it fails the base rules. Rows that repeat get a
row each. An empty table gives an empty result. Without labels of both classes the learnt rule says 1
(or the only class there is) for every text. Columns beside doc_id and text are not looked at, so
clashing names in them do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from . import textbytes as tb
from .common import by_texts, labelled_sample, renamed, table

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A text is kept if its calibrated probability of quality 1 is at least this.
THRESHOLD = 0.1
#: The model learns from at most this many labelled rows of each class (whole texts).
SAMPLE_PER_CLASS = 1000
#: Characters that count as symbols (fixed value of the contract).
SYMBOLS = tb.byte_set(b"#*$%&|<>")

_NEWLINE = ~tb.byte_set(b"\n")
_NOT_CONTINUED = tb.byte_set(ranges=((0x00, 0x7F), (0xC0, 0xFF)))

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, quality_p double"


def repeated_lines(texts: tb.Texts, words: tb.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = tb.runs(_NEWLINE[texts.data], texts.offsets)
    has = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    of_text = lines.texts()[has]
    lines = tb.Words(lines.starts[has], lines.ends[has], np.searchsorted(of_text, np.arange(len(texts) + 1)))
    keys = tb.word_hashes(texts.data, lines) ^ tb.mix(of_text.astype(np.uint64) + np.uint64(1))
    kept = np.unique(keys, return_index=True)[1]
    return lines.counts() - np.bincount(of_text[kept], minlength=len(texts))


def repeated_words(words: tb.Words, hashes: np.ndarray, window: int = 5) -> np.ndarray:
    """Words in windows that occur twice or more in their text."""
    runs, offsets, firsts = tb.grams(hashes, words.offsets, window)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    twice = tb.repeated(runs ^ tb.mix(owner + np.uint64(1)))
    return tb.flag_sums(tb.covered(len(hashes), firsts[twice], window), words.offsets)


def measured(texts: tb.Texts, model: features.LogisticModel) -> dict[str, np.ndarray]:
    words = texts.words(tb.NON_SPACE)
    hashes = tb.word_hashes(texts.data, words)
    return {
        "n_words": words.counts(),
        "word_chars": texts.count(tb.NON_SPACE & _NOT_CONTINUED),
        "n_symbols": texts.count(SYMBOLS),
        "n_dup_lines": repeated_lines(texts, words),
        "n_repeat_words": repeated_words(words, hashes),
        "quality_p": model.probability(features.hashed(texts, words, hashes, model.bits)),
    }


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> features.LogisticModel:
    return features.LogisticModel.fit(*labelled_sample(docs, labels, "quality", per_class))


def score(docs: DataFrame, model: features.LogisticModel, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The `keep` columns of docs with the counts, quality_p, base_failed and kept."""
    out = by_texts(docs, keep, text, SCHEMA, lambda: lambda texts, n: measured(texts, model))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality_p") >= F.lit(threshold)))


def passing(docs: DataFrame, model: features.LogisticModel) -> DataFrame:
    """The documents that are kept, with all their columns."""
    own, named = renamed(docs)
    return score(own, model, own.columns, named["text"]).where("kept").select(*[F.col(named[c]).alias(c) for c in docs.columns])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
