"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read by the next.

``STAGES`` lists them; each takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of
``docs``.  ``run`` applies them to ``documents``.  No SQL expresses the stages; tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import decontaminate, mixing, quality, similar, simhash, tokens
from flowmill.llm.common import fresh, held_out, table
from flowmill.llm.queries import END_ID, MIX_CAP, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, QUALITY_THRESHOLD, TOKENIZER

ORACLE_SQL = None


#: Texts may be long, so Python takes few rows at a time: a batch of some MB instead of a whole file's part.
ARROW_ROWS, BATCH_ROWS = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set on the session, for a stage's plan takes the setting when its rows are written; :func:`run` restores what was set before."""
    spark.conf.set(BATCH_ROWS, ARROW_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones of ``docs``, scores at the threshold or above.

    Null and empty texts have a score like any other, rows without ids too; repeated rows stay or go together.
    """
    small_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = fresh(docs, "score")
    return quality.score(docs, model, name=score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays (null last), and one of repeated rows.  Null texts and texts without words are one group.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, similar.similar_documents(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null texts stay; repeated rows stay or go together."""
    small_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's target asks for.

    A null source is one of its own; texts without words have size 0; rows without ids are drawn by their texts.
    """
    return mixing.mix(docs, MIX_WEIGHTS, share=MIX_SHARE, cap=MIX_CAP, seed=MIX_SEED)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in binary shards; what the files hold of each, read back."""
    small_batches(spark)
    folder = tokens.new_folder(spark)
    tokens.write_token_files(docs, public_tokenizers.path(TOKENIZER), folder, end_id=END_ID)
    return tokens.read_token_files(spark, folder)


STAGES = [("quality", keep_good), ("near duplicates", drop_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("tokens", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_ROWS)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                folder = tokens.new_folder(spark, f"stage{k}")
                docs.write.parquet(folder)
                docs = spark.read.parquet(folder)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return docs
