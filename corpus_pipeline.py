"""A corpus from `documents` to shards: without toxic texts, near copies and benchmark passages, mixed to target weights.

Each stage takes all that its predecessor kept, as Parquet in the folder that the session's spark.checkpoint.dir names, and
all but the last return the columns of `documents`. A lost executor repeats tasks of one stage at most.

Defined cases, for all stages: columns beyond those of `documents` pass by under any name, but for the last stage; an empty
table gives an empty one; texts of any length are taken whole. Each stage says what it does with nulls, ties and repeated rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, jaccard, mixing, sharding, toxicity
from tidemark.llm.common import shared_dir, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more (operator 4); the model is fitted on `documents` with `labels`.

    Null, empty and wordless texts have no evidence and stay; rows that share a doc_id are scored each by its own text; without
    labels of both classes nothing goes.
    """
    model = toxicity.fit(*toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the one with the least id (operator 9).

    A null id is greater than all others; of rows equal in id and text one stays; rows without words, null texts included,
    are linked with nothing and all stay.
    """
    return jaccard.first_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item (operator 1).

    Null and wordless texts have no windows and stay; wordless items have none either; rows that share an id, or have
    none, are judged by their own texts.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for (operator 8).

    The null source is one like others, the last; rows that share a doc_id share their draw, as null ids do; null and empty
    texts have no words, and a source of nothing else has target 0 and goes.
    """
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every copy (operator 7).

    Null texts are empty ones; copies and other rows of one text lie in one shard; null ids come first there.
    """
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_copies", first_of_near_copies),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
