"""Sequential state per key: adaptive thresholds, failure guards, resumable file streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

START, RATE, WARM_UP, RECENT, ENOUGH, TOP, BOTTOM, TARGET = 0.5, 0.05, 10, 50, 5, 0.99, 0.01, 0.8


def step(threshold: float, history: list[tuple[float, bool]], confidence: float, correct: bool) -> float:
    """Threshold after one more observation; ``history`` is kept to the recent ones.

    After the warm-up, with enough recent observations at or above the threshold, it rises by the rate if
    their accuracy is below the target, else falls by half of it.
    """
    history.append((confidence, correct))
    del history[:-RECENT]
    if len(history) < WARM_UP:
        return threshold
    above = [ok for c, ok in history if c >= threshold]
    if len(above) < ENOUGH:
        return threshold
    return min(TOP, threshold + RATE) if sum(above) / len(above) < TARGET else max(BOTTOM, threshold - RATE / 2)


def adaptive_thresholds(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Final threshold per key after its rows in order. The state is sequential by nature: a key is walked by one task,
    which sorts its rows outside Python memory and holds RECENT observations at a time."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, threshold, history, n = None, START, [], 0
        rows = []
        for part in parts:
            for k, c, ok in zip(part[key], part["confidence"], part["correct"]):
                if k != at:
                    if at is not None:
                        rows.append((at, n, round(threshold, 6)))
                    at, threshold, history, n = k, START, [], 0
                threshold = step(threshold, history, c, bool(ok))
                n += 1
        if at is not None:
            rows.append((at, n, round(threshold, 6)))
        yield pd.DataFrame(rows, columns=[key, "n", "threshold"])

    clean = df.filter(F.col(key).isNotNull() & F.col("confidence").isNotNull() & F.col("correct").isNotNull())
    sorted_rows = clean.repartition(key).sortWithinPartitions(key, *order)
    return sorted_rows.mapInPandas(walk, f"`{key}` {dict(df.dtypes)[key]}, n bigint, threshold double")


def adaptive_threshold_stream(stream: DataFrame, key: str) -> DataFrame:
    """The same on a stream (key, confidence, correct): one row per key and trigger with its threshold so far."""

    def update(k: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, threshold, confidences, hits = state.get if state.exists else (0, START, [], [])
        history = list(zip(confidences, hits))
        for part in parts:
            for c, ok in zip(part["confidence"], part["correct"]):
                threshold = step(threshold, history, float(c), bool(ok))
                n += 1
        state.update((n, threshold, [c for c, _ in history], [ok for _, ok in history]))
        yield pd.DataFrame([(k[0], n, round(threshold, 6))], columns=[key, "n", "threshold"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n bigint, threshold double", "n bigint, threshold double, confidences array<double>, hits array<boolean>", "update", GroupStateTimeout.NoTimeout)


class FailureGuard:
    """foreachBatch function that stops a stream when too many of at least ``least`` rows failed."""

    def __init__(self, failed: str, rate: float = 0.2, least: int = 10, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        self.failed, self.rate, self.least, self.sink = failed, rate, least, sink
        self.seen = self.bad = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        n, bad = batch.agg(F.count("*"), F.count_if(F.col(self.failed))).first()
        self.seen, self.bad = self.seen + n, self.bad + bad
        if self.sink:
            self.sink(batch, batch_id)
        if self.seen >= self.least and self.bad / self.seen > self.rate:
            raise RuntimeError(f"{self.bad} of {self.seen} rows failed")


def process_new_files(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Processes the JSON files that came since the last call exactly once (the checkpoint remembers them)."""
    query = transform(spark.readStream.schema(schema).json(folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key has not been done."""
    return items.join(done.select(key).distinct(), key, "left_anti")
