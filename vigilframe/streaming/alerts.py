"""Levels and cooldowns of a stream: a stateful processor per (host, template)."""

from __future__ import annotations

from typing import Any, Iterator

from pyspark.sql import DataFrame, Row, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilframe.config import AnalysisConfig
from vigilframe.operators.scoring import LEVELS

STATE = "level int, last_ts bigint, last_level int, suppressed bigint"


class AlertFold(StatefulProcessor):
    """Level with hysteresis, then one alert per cooldown, for one (host, template) at a time.

    Rows are scored events; those of a micro-batch are put in order, so only micro-batches must follow one
    another in time.  State: the level, time and level of the last alert, and how many were held back
    since.  A template at normal level with nothing held back and no cooldown running has no state, so the
    state holds the templates that were in trouble when last seen.  (No time-to-live: it needs processing
    time, with which a stream that reads what is there never ends.)
    """

    def __init__(self, cfg: AnalysisConfig, output: T.StructType):
        self.enter = (cfg.info_threshold, cfg.warn_threshold, cfg.critical_threshold)
        self.exit_factor = min(max(cfg.exit_factor, 0.0), 1.0)
        self.cooldown = cfg.cooldown_us
        self.names = output.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", STATE)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.state.update((initialState.level, initialState.last_ts, initialState.last_level, initialState.suppressed))

    def _level(self, before: int, score: float) -> int:
        raw = sum(score >= t for t in self.enter)
        return before if before > raw and score >= self.enter[before - 1] * self.exit_factor else raw

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        level, last_ts, last_level, held = self.state.get() if self.state.exists() else (0, None, 0, 0)
        now = None
        for row in sorted(rows, key=lambda r: (r.ts_us, r.seq)):
            level, now = self._level(level, row.combined), row.ts_us
            if not level:
                continue
            if row.in_learning:
                yield self._out(row, level, "suppressed_learning", 0)
            elif last_ts is None or level > last_level or now - last_ts >= self.cooldown:
                yield self._out(row, level, "emitted", held)
                last_ts, last_level, held = now, level, 0
            else:
                held += 1
                yield self._out(row, level, "suppressed", 0)
        over = last_ts is None or now is not None and now - last_ts >= self.cooldown
        if level == 0 and held == 0 and over:
            self.state.clear()
        else:
            self.state.update((level, last_ts, last_level, held))

    def _out(self, row: Row, level: int, disposition: str, held: int) -> Row:
        record = row.record if disposition == "emitted" else None
        return Row(*self.names)(row.hostname, row.template_id, row.ts_us, row.seq, LEVELS[level], disposition, held, record)

    def close(self) -> None:
        pass


def fold_schema(scored: T.StructType) -> T.StructType:
    """Columns that `fold_stream` gives for scored rows of this schema."""
    return T.StructType(
        [
            scored["hostname"], scored["template_id"], T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()),
            T.StructField("level", T.StringType()), T.StructField("disposition", T.StringType()),
            T.StructField("suppressed_since_last", T.LongType()), T.StructField("record", scored["record"].dataType),
        ]
    )


def fold_stream(scored: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), state: DataFrame | None = None) -> DataFrame:
    """Events above normal level with their ``disposition``; those emitted carry their record.

    ``scored`` is a stream with hostname, template_id, ts_us, seq, combined, in_learning and record (null
    where the score is too low for any level).  ``state`` (hostname, template_id and the columns of STATE):
    where to start.  Needs the RocksDB state store.
    """
    output = fold_schema(scored.schema)
    initial = None if state is None else state.groupBy("hostname", "template_id")
    return scored.groupBy("hostname", "template_id").transformWithState(
        AlertFold(cfg, output), outputStructType=output, outputMode="Append", timeMode="None", initialState=initial
    )
