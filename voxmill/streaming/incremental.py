"""Work that resumes: only what is not in the output yet is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.joins import pending
from ..sources.writers import write_judged


def resume(source: DataFrame, done: DataFrame | None, key: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``process`` over the rows whose key is not done."""
    return process(source if done is None else pending(source, done, key))


def run_incremental(stream: DataFrame, output: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Every micro-batch is processed and written to its own folder of ``output``.

    A batch that is run again after a failure overwrites its folder, so results are
    there exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_judged(stream: DataFrame, root: str, checkpoint: str, reason: str = "reason") -> StreamingQuery:
    """Judged groups as they come: pairs, discarded groups and a manifest below ``root``, batch by batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_judged(batch, root, number, reason)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
