"""Answer audits over a stream: each micro-batch goes through the same batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def route_stream(signals: DataFrame, gates, path: str, checkpoint: str):
    """Routes a streaming table of signals and appends decisions as Parquet; gates are expressions, so no state is kept."""
    from lexigrid.operators.routing import evaluate_gates

    routed = evaluate_gates(signals, gates).drop("results")
    return routed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
