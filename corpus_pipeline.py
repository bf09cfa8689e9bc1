"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``documents``; ``run`` writes each stage's rows as Parquet to the shared folder and reads
them back as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from econcheck.llm import bpe, decontaminate, langid, ngram_join, quality
from econcheck.llm.queries import table
from econcheck.llm.store import written

#: below this share of the family and the language a prediction counts as none
LEAST_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of one half or more; `und` goes.

    Learnt from the stage's own input, as the query does. Extra columns stay.
    """
    table(spark, sf_dir, "documents")
    part = langid.remainder(F.col("doc_id"), 4)
    model = langid.fit_languages(docs.select("doc_id", "lang", "text").where(part != 2))
    named = langid.identify(docs, model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality 1, from labels of the query's training part."""
    labels = table(spark, sf_dir, "labels").where(quality.remainder(F.col("doc_id"), 5) != 0)
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five words, 0.75).

    Documents without words are no copies of each other and stay. Where rows of one doc_id have
    different texts, each text is a document of its own in the groups; of those that are no copy
    of another one text stays, the first in order. A null doc_id stays.
    """
    table(spark, sf_dir, "documents")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        copies = ngram_join.ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    keys = docs.where("doc_id is not null").select(own.alias("own"), "doc_id").distinct()
    groups = ngram_join.ngram_components(docs.select(own.alias("doc_id"), "text")).where("doc_id is not null").select(F.col("doc_id").alias("own"), "component_id").distinct()
    least = groups.join(keys, "own").groupBy("component_id").agg(F.min(F.struct("doc_id", "own")).alias("r")).select(F.col("r.own").alias("_own"))
    named = docs.withColumn("_own", own)
    kept = named.where("_own is null").union(named.join(least, "_own", "left_semi").select(*named.columns)).select(*docs.columns)
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    first = again.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(first.select("doc_id", "r.*").select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item by greedy string tiling."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the digests of the ids and of their decoding, for each document kept."""
    table(spark, sf_dir, "documents")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: learnt models and digests of token ids are not expressible in SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
