"""The usage roll-up on a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from econcheck.operators.usage import anonymise, country_texts, known_texts, labelled_by_dictionary, usage_measures, with_means
from econcheck.plans.durable import cut_lineage

DEFAULT_WINDOW = "1 hour"


def partial_roll_up(clean: DataFrame, by: list[str], window: str = DEFAULT_WINDOW) -> DataFrame:
    """Additive measures per tumbling window and group."""
    return clean.groupBy(F.window("ts", window)["start"].alias("window_start"), *by).agg(*usage_measures())


def windowed_roll_up(clean: DataFrame, by: list[str], window: str = DEFAULT_WINDOW) -> DataFrame:
    return with_means(partial_roll_up(clean, by, window))


def read_event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_usage_sink(
    raw: DataFrame,
    known_codes,
    by: list[str],
    path: str,
    checkpoint: str,
    known_indicators: list[str] | None = None,
    window: str = DEFAULT_WINDOW,
    trigger: str | None = None,
    dictionary: str | None = None,
):
    """Write each micro-batch's partial sums to its own folder under ``path``.

    With ``dictionary``, a folder, ``known_codes`` are the economies: each distinct country
    text is resolved once in the life of the stream and kept there, and every micro-batch
    is joined to that table.

    The measures add up, so no row is ever too late and the stream keeps no state; a batch
    that is run again after a failure overwrites its own folder only.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        if dictionary is None:
            clean = anonymise(batch, known_codes, known_indicators)
        else:
            clean = anonymise(labelled_by_dictionary(batch, _learn(batch, batch_id, known_codes, dictionary)), None, known_indicators)
        sums = partial_roll_up(clean, by, window)
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def _learn(batch: DataFrame, batch_id: int, economies: DataFrame, folder: str) -> DataFrame:
    """The dictionary with the batch's new texts; a batch that is run again writes its own part anew."""
    spark = batch.sparkSession
    texts = country_texts(batch)
    known = read_dictionary(spark, folder, batch_id)
    new = cut_lineage(texts.join(known, "name", "left_anti"))
    known_texts(new, economies).select("name", "iso3").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return read_dictionary(spark, folder, batch_id + 1)


def read_dictionary(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(name, iso3) of every text resolved so far, or in the batches ``before`` one."""
    if before == 0:
        return spark.createDataFrame([], "name string, iso3 string")
    parts = spark.read.option("basePath", folder).schema("name string, iso3 string, batch long").parquet(folder)
    return (parts if before is None else parts.where(F.col("batch") < before)).select("name", "iso3")


def read_usage(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The roll-up over everything the sink has written so far."""
    sums = spark.read.parquet(path).groupBy("window_start", *by)
    return with_means(sums.agg(*[F.sum(c).alias(c) for c in ("events", "total_ms", "ok_events")]))
