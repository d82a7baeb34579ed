"""Counters of a running stream: what each micro-batch observed is added up and reported while the stream goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener


class ProgressListener(StreamingQueryListener):
    """Reports ``report(phase, counts)`` after each micro-batch of a stream that is observed under the name of the phase; counts are those since the listener was
    made. They never go back, so events made of them fold to the last one whatever their order (``stores.fold_progress``)."""

    def __init__(self, phase: str, report: Callable[[str, dict[str, int]], None]):
        self.phase, self.report, self.counts = phase, report, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if (row := event.progress.observedMetrics.get(self.phase)) is not None:
            for name, n in row.asDict().items():
                self.counts[name] = self.counts.get(name, 0) + (n or 0)
            self.report(self.phase, dict(self.counts))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def observed(stream: DataFrame, phase: str, **metrics: Column) -> DataFrame:
    """The stream, with metrics that a listener of the phase gets after each micro-batch."""
    return stream.observe(phase, *(c.alias(n) for n, c in metrics.items()))
