"""Embedding as a file-source stream: every trigger embeds what arrived and is not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weftlink.operators.embedding import Backend, Preprocessor, embed_works


def embed_arrivals(
    spark: SparkSession,
    inbox: str,
    schema: str,
    root: str,
    checkpoint: str,
    source: str,
    config: str,
    variant: str,
    backend: Backend,
    preprocessor: Preprocessor | None = None,
) -> StreamingQuery:
    """Process the files waiting in ``inbox`` and stop.

    A batch replayed after a failure adds nothing: texts already stored are not pending.
    """
    arrivals = spark.readStream.schema(schema).parquet(inbox)

    def step(batch: DataFrame, _: int) -> None:
        embed_works(batch, root, source, config, variant, backend, preprocessor)

    return (
        arrivals.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def format_eta(seconds: float) -> str:
    minutes = int(seconds // 60)
    return f"{minutes // 60}h{minutes % 60:02d}m"


def progress_line(done: int, total: int, elapsed: float) -> str:
    """Rows done, rate and time left."""
    rate = done / elapsed if elapsed > 0 else 0.0
    left = format_eta((total - done) / rate) if rate > 0 else "unknown"
    share = 100 * done / total if total else 100.0
    return f"{done:,}/{total:,} ({share:.1f}%) {rate:.1f} rows/s, {left} left"


class ProgressListener(StreamingQueryListener):
    """Prints one progress line per finished batch of a stream."""

    def __init__(self, total: int, write=print) -> None:
        self.total, self.write = total, write
        self.done, self.elapsed = 0, 0.0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.done += event.progress.numInputRows
        self.elapsed += event.progress.batchDuration / 1000
        self.write(progress_line(self.done, self.total, self.elapsed))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
