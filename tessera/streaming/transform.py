"""A fitted feature model on a stream: a projection and lookups in static tables, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.plans.compiler import FeatureModel


def transform_stream(stream: DataFrame, model: FeatureModel, keep: tuple[str, ...] = ()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed; use model.transform for tables")
    return model.transform(stream, keep=keep)
