"""The row operators are plain projections, so they run unchanged over a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import rows


def normalize_stream(spark: SparkSession, folder: str, schema: str, normalizer: str = "whitespace") -> DataFrame:
    """JSON lines that arrive in ``folder``, normalised."""
    return rows.normalize_rows(spark.readStream.schema(schema).json(folder), normalizer)


def to_parquet(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet exactly once, until what is there is done."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
