"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on every document its
predecessor kept.  All but the last return the columns of ``documents``:

quality_rules      documents that fail the base or leave a fertility band go
line_dedup         repeated chunks of lines, the repeated lines around them and
                   repeated long lines are cut from the texts; a document that
                   loses all its lines goes, since its text stands elsewhere
ngram_jaccard      of each group of near copies (five-word shingles, similarity
                   0.8 or more) the document with the smallest id stays
decontamination    documents with a run of ten benchmark words go
sentencepiece      token ids of every text, with parity and round trip checked
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerlake.llm.decontam import drop_contaminated
from kmerlake.llm.fertility import keep_quality
from kmerlake.llm.jaccard import keep_one_of_each
from kmerlake.llm.linededup import dedup_lines
from kmerlake.llm.queries import piece_model
from kmerlake.llm.spm import encode
from kmerlake.llm.tables import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, piece_model())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, drop_emptied=True, extend=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("cut_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, piece_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages cannot be told in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
