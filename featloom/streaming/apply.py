"""Fitted features on a stream: with frozen statistics every feature is a stateless projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from featloom.dataset import Dataset, quoted
from featloom.operators.expr import Expr, to_column
from featloom.session import work_dir


def stream_features(stream: DataFrame, fitted: Dataset, exprs: Sequence[Expr], keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` and the expressions, evaluated on a table shaped like the fitted one.

    The statistics inside the expressions are those of the fitted table; nothing is read again.
    """
    values = fitted.with_df(stream).values()
    named = [to_column(e, values).alias(e.name) for e in exprs]
    return stream.select(*[quoted(c) for c in keep], *named)


def write_features(features: DataFrame, path: str, name: str = "features") -> StreamingQuery:
    """Append the features to Parquet; progress is kept in the shared work folder."""
    checkpoint = f"{work_dir(features.sparkSession)}/featloom/stream-{name}"
    writer = features.writeStream.format("parquet").outputMode("append").queryName(name)
    return writer.option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
