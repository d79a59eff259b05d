"""Extension: N-Triples files that keep arriving, as a stream of triples, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplespark.sources.ntriples import statements


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Triples of the files that appear in a folder."""
    return statements(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def append(triples: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Start writing a stream of triples to Parquet; each file's statements arrive exactly once."""
    writer = triples.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path)
