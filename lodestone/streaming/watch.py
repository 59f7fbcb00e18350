"""What a stream's events start: a save of its state after enough changes and time, and the note that it has gone quiet."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Watch(StreamingQueryListener):
    """Counts the rows of all queries since the last save, and keeps when each query was last heard of.

    A save runs in a thread of its own, one at a time, so events go on; it starts with the first event, also of an idle query, at which `events` rows
    are pending and `seconds` have passed. Rows that come meanwhile count for the next one. If it fails, its rows are pending again, and error has why.
    """

    def __init__(self, save: Callable[[], object] | None = None, events: int = 500, seconds: float = 30.0, stale_after: float = 60.0, clock: Callable[[], float] = time.time):
        self.save, self.events, self.seconds, self.stale_after, self.clock = save, events, seconds, stale_after, clock
        self.pending, self.saves, self.saved_at = 0, 0, clock()
        self.heard: dict[str, float] = {}
        self.ended: dict[str, str | None] = {}
        self.error: Exception | None = None
        self._lock, self._saving = threading.Lock(), None

    def onQueryStarted(self, event) -> None:
        self.heard[str(event.id)] = self.clock()
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        self.heard[str(event.progress.id)] = self.clock()
        with self._lock:
            self.pending += max(0, event.progress.numInputRows)
        self._save_if_due()

    def onQueryIdle(self, event) -> None:
        self.heard[str(event.id)] = self.clock()
        self._save_if_due()

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def _save_if_due(self) -> None:
        with self._lock:
            if self.save is None or self._saving or self.pending < self.events or self.clock() - self.saved_at < self.seconds:
                return
            taken, self.pending = self.pending, 0
            self._saving = threading.Thread(target=self._run, args=(taken,), daemon=True)
            self._saving.start()

    def _run(self, taken: int) -> None:
        try:
            self.save()
            self.saves += 1
        except Exception as error:  # the stream goes on; the next event tries again
            self.error, self.pending = error, self.pending + taken
        finally:
            with self._lock:
                self.saved_at, self._saving = self.clock(), None

    def stale(self) -> list[str]:
        """Ids of the queries that weren't heard of for stale_after seconds or have ended with an error: what they keep may be old."""
        now = self.clock()
        return sorted(q for q, at in self.heard.items() if (self.ended[q] is not None if q in self.ended else now - at > self.stale_after))


def watch(spark: SparkSession, save: Callable[[], object] | None = None, **policy) -> Watch:
    """A Watch that hears of all queries of the session from now on; `spark.streams.removeListener` ends it."""
    listener = Watch(save, **policy)
    spark.streams.addListener(listener)
    return listener
