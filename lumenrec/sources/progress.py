"""How far a job has come: rows as they are counted on the way, and batches of a stream as they end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(df: DataFrame, name: str, **more) -> tuple[DataFrame, Observation]:
    """df, and what the next action that reads all of it counts on the way, without a job of its own: rows, and more columns of aggregates by name."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()]), seen


class BatchProgress(StreamingQueryListener):
    """Calls say(query's name, batch number, rows read, rows a second) for each batch of a stream that had rows, and keeps the totals by name."""

    def __init__(self, say: Callable[[str, int, int, float], None] = lambda *_: None):
        self.say, self.rows = say, {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.rows[p.name] = self.rows.get(p.name, 0) + p.numInputRows
            self.say(p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
