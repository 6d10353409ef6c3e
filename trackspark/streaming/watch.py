"""What streams have last said, for errors that tell more than that a stream has died."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Watch(StreamingQueryListener):
    """A listener that keeps, per stream, how many rows it has read, its last lines and its error."""

    def __init__(self, lines: int = 20):
        self.lines, self.rows, self.errors, self.said = lines, {}, {}, {}

    def _say(self, run: str, line: str) -> None:
        self.said.setdefault(run, deque(maxlen=self.lines)).append(line)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self._say(str(event.runId), f"{event.timestamp} started {event.name or ''}".rstrip())

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        p = event.progress
        run = str(p.runId)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        self._say(run, f"{p.timestamp} batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        run = str(event.runId)
        if event.exception:
            self.errors[run] = event.exception
        self._say(run, "ended" if not event.exception else "died: " + event.exception.splitlines()[0])

    def tail(self, run: str) -> str:
        """The last lines of a stream's run."""
        return "\n".join(self.said.get(run, ()))


def watched(spark: SparkSession, lines: int = 20) -> Watch:
    """A watch on all streams of the session from now on."""
    watch = Watch(lines)
    spark.streams.addListener(watch)
    return watch
