"""An analysis fed piece by piece: consume, consume, ..., finalize."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.normalize import complete
from tidelog.operators.transactions import RUN
from tidelog.options import AnalysisOptions
from tidelog.plans.analyze import AnalysisResult, analyze
from tidelog.schemas import EVENT

#: Places in the total order for each frame given; lists take one place an event.
FRAME_SPAN = 1 << 48


class Analyzer:
    """Takes events in order, singly, in lists or as frames with seq; finalize() gives the result.

    finalize() gives the same result each time.  After it nothing more is
    taken, and an analysis that failed stays failed.
    """

    def __init__(self, spark: SparkSession, options: AnalysisOptions | None = None, run: int = RUN):
        self.spark, self.options, self.run = spark, options or AnalysisOptions(), run
        self._frames: list[DataFrame] = []
        self._rows: list[dict] = []
        self._result: AnalysisResult | None = None
        self._failure: Exception | None = None

    def _check(self) -> None:
        if self._failure is not None:
            raise self._failure
        if self._result is not None:
            raise ValueError("analyzer already finalized")

    def consume(self, event: dict) -> None:
        self._check()
        self._rows.append(event)

    def consume_all(self, events: Iterable[dict]) -> None:
        for e in events:
            self.consume(e)

    def consume_frame(self, events: DataFrame) -> None:
        """A frame of normalised events; they come after all that was taken before."""
        self._check()
        self._flush()
        shift = len(self._frames) * FRAME_SPAN
        self._frames.append(complete(events).withColumn("seq", F.col("seq") + shift))

    def _flush(self) -> None:
        if self._rows:
            shift = len(self._frames) * FRAME_SPAN
            named = [{n: r.get(n) for n in EVENT.names} | {"seq": shift + k} for k, r in enumerate(self._rows)]
            self._frames.append(complete(self.spark.createDataFrame(named, EVENT)))
            self._rows = []

    def finalize(self) -> AnalysisResult:
        if self._failure is not None:
            raise self._failure
        if self._result is None:
            self._flush()
            events = self._frames[0] if self._frames else complete(self.spark.createDataFrame([], EVENT))
            for frame in self._frames[1:]:
                events = events.unionByName(frame)
            try:
                self._result = analyze(events, self.options, self.run)
            except Exception as why:
                self._failure = why
                raise
        return self._result
