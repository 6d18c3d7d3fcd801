"""Training logs as streams: pairs of metrics and acceptances, round averages and the best so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.trainlog import log_events

PAIR = "run string, site string, line bigint, round int, value double"
#: State stores that keep lists and timers need this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Pairing(StatefulProcessor):
    """Of one site: the stack of metrics that are not taken, up to a line that is settled, and the lines after it."""

    def __init__(self, late: int, idle_ms: int | None):
        self.late, self.idle_ms = late, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "stack array<double>, line bigint")
        self.waiting = handle.getListState("waiting", "line bigint, accept boolean, round int, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        stack, last = (list(self.settled.get()[0]), self.settled.get()[1]) if self.settled.exists() else ([], -1)
        lines = {x[0]: x for x in self.waiting.get()} if self.waiting.exists() else {}
        out = []
        for e in pd.concat(list(rows)).itertuples():
            if e.line <= last:
                out.append((*key, e.line, None if pd.isna(e.round) else int(e.round), None, True))
            else:
                lines[int(e.line)] = (int(e.line), e.kind == "accept", None if pd.isna(e.round) else int(e.round), None if pd.isna(e.value) else float(e.value))
        due = max(lines, default=last) - self.late
        rest = [x for x in sorted(lines.values()) if x[0] > due]

        def match(some: list[tuple], stack: list[float]) -> None:
            for line, accept, number, value in some:
                if not accept:
                    stack.append(value)
                else:
                    out.append((*key, line, number, stack.pop() if stack else None, False))

        match([x for x in sorted(lines.values()) if x[0] <= due], stack)
        self.settled.update((stack, max(last, due)))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        match(rest, list(stack))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["run", "site", "line", "round", "value", "late"]).astype({"round": "Int32", "value": "float64", "late": "bool"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.settled.clear()
        self.waiting.clear()
        return iter([])

    def close(self) -> None:
        pass


def pair_stream(lines: DataFrame, late: int = 10_000, idle_ms: int | None = None) -> DataFrame:
    """(run, site, line, round, value, late): acceptances with their metrics, from a stream of (run, line, text).

    Lines may come in any order as long as none comes when a line of its site that lies more than `late` lines
    on has come. State per run and site: the metrics that are not taken, and the lines of the last `late`,
    in whose order they are matched anew with each batch. So an acceptance can be listed several times; its
    last row, by batch, holds, with a null value where nothing is open for it (see last_pairs). A line that comes too late
    is listed with late = true and takes no part. State ends when a site has sent nothing for idle_ms, if that
    is given (not for availableNow, whose query would wait for the time to pass). Write it in update mode,
    with a state store of PROVIDER.
    """
    events = log_events(lines).filter(F.col("kind").isin("metric", "accept"))
    mode = "none" if idle_ms is None else "processingTime"
    return events.groupBy("run", "site").transformWithStateInPandas(_Pairing(late, idle_ms), f"{PAIR}, late boolean", "update", mode)


def last_pairs(rows: DataFrame) -> DataFrame:
    """(run, site, line, round, value): what holds of rows of pair_stream with the number of their batch (batch)."""
    last = rows.filter("not late").groupBy("run", "site", "line").agg(F.max_by(F.struct("round", "value"), "batch").alias("x"))
    return last.select("run", "site", "line", "x.*").filter("value is not null")


def round_average_stream(pairs: DataFrame) -> DataFrame:
    """(run, round, loss, n): running mean loss of each round, from a stream of pairs; write it in update mode."""
    return pairs.groupBy("run", "round").agg(F.avg(-F.col("value")).alias("loss"), F.count("*").alias("n"))


def best_stream(lines: DataFrame) -> DataFrame:
    """(run, round, best): the last new best of each run so far; write it in update mode."""
    best = log_events(lines).filter("kind = 'best'")
    return best.groupBy("run").agg(F.max_by(F.struct("round", "value"), "line").alias("b")).select("run", F.col("b.round").alias("round"), F.col("b.value").alias("best"))
