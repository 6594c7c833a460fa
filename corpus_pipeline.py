"""A corpus cleaned in five stages; each calls one operator of ordina.llm and reads what the stage before wrote.

1. quality rules: documents that fail the counted rules or the learnt one go.
2. near-duplicates: one document of each class stays (the smallest doc_id).
3. benchmark decontamination: spans that match benchmark items go; documents that mostly consist of them go.
4. personal data: spans are replaced by their kind.
5. SentencePiece: texts become ids.

The model of stage 1 learns from labelled documents of the stage's own input.

Defined results: a null or empty text fails the counted rules and goes with stage 1; rows that repeat a doc_id and its
text stay once after stage 2, rows of one doc_id with different texts are different documents; an empty table gives no
rows. Other columns pass through every stage; input columns named n_ids, ids or round_trip come out with `_in` at the
end of their names. Each stage is a table in the shared folder, so a lost executor only costs its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordina.llm import decontamination, near_duplicates, pii, quality_rules, sentencepieces
from ordina.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, decontamination.load(table(spark, sf_dir, "benchmark")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, sentencepieces.Vocabulary.load(), [c for c in docs.columns if c != "text"])


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("pii", private),
    ("sentencepieces", pieces),
]

#: No SQL: stages 1, 2, 4 and 5 are models, sketches and a dynamic programme. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
