"""Corpus cleaning in stages; each stage's rows are written and read again by the next.

toxicity -> near-duplicates -> repeated strings -> personal data -> packing. All
stages but the last return the columns of ``documents``, whatever those are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import free, shared_folder, table, tokenizer_path
from chronoloom.llm.minhash import without_near_duplicates
from chronoloom.llm.packing import pack
from chronoloom.llm.pii import redacted
from chronoloom.llm.repeats import without_repeats
from chronoloom.llm.toxicity import fit, score


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not find toxic. It learns from the stage's own documents and the labels table.

    Null and empty texts score as the bias says, which is clean unless most labels
    are toxic. Repeated rows go or stay alike, whatever their ids. Without labels
    nothing is rejected. Other columns pass as they are; an empty table stays empty.
    """
    weights, bias = fit(docs, table(spark, sf_dir, "labels"))
    names = free(docs, "score"), free(docs, "toxic")
    return score(docs, weights, bias, names).where(F.col(names[1]) == 0).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares word shingles of five words to 0.8 or more, one of least id.

    Every row counts by itself, also one that repeats another's id or has none.
    Documents without words (null, empty, white space) all stay. Other columns
    pass as they are; an empty table stays empty.
    """
    return without_near_duplicates(docs, size=5, percent=80, spare_nameless=False)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once among them; every place loses them.

    No row goes: a text that is repeated as a whole becomes empty, a null stays
    null, texts under 200 bytes stay as they are. ``n_chars`` follows the text.
    """
    return _counted(without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with identifiers, plain or disguised, replaced by their kind in brackets.

    Null and empty texts stay; overlapping finds become one bracket. ``n_chars`` follows the text.
    """
    return _counted(redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing operator gives them; a null or empty text is its end id alone."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: No SQL: the first stage trains a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows lie in the cluster's shared folder until the next one's do; the last ones stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
