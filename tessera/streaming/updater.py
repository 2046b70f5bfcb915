"""A daily updater for each ledger, as a keyed state machine: works on streams and, in one go, on batches.

A run asks for data up to a day.  State is the latest market day and the latest
day with a decision; each run ends in one status:

    refused_truncate      it asks for less than is known
    no_new_market_data    nothing new, and the latest day has its decision
    decision_recovered    nothing new, but the latest day lacked its decision, and gets it
    refused_stale         the day that lacks a decision is more than STALE_DAYS old
    refused_fetch_errors  new data came with errors; the days stay known
    no_new_trading_day    new days, none of them with a market
    decision_recorded     a new market day gets its decision

A run number that isn't above the last one of its ledger was seen before: a
replayed or repeated run changes nothing and gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Fixed value: days after which a decision isn't made up for.
STALE_DAYS = 3
_OUT = "ledger string, run long, status string, market_day date, decision_day date"
_STATE = "run long, market_day int, decision_day int"
_NEVER = -(1 << 30)
_START = (-1, _NEVER, _NEVER)


def settle(end: int, market: int, today: int, errors: int, known: int, decided: int) -> tuple[str, int, int]:
    """Status, and the market and decision day after a run; days as numbers."""
    if end < known:
        return "refused_truncate", known, decided
    if end == known:
        if decided == known:
            return "no_new_market_data", known, decided
        return ("refused_stale", known, decided) if known < today - STALE_DAYS else ("decision_recovered", known, known)
    latest = max(known, market)
    if errors:
        return "refused_fetch_errors", latest, decided
    if latest <= known:
        return "no_new_trading_day", known, decided
    return ("refused_stale", latest, decided) if latest < today - STALE_DAYS else ("decision_recorded", latest, latest)


def _walk(ledger: str, runs: pd.DataFrame, state: tuple[int, int, int]) -> tuple[pd.DataFrame, tuple[int, int, int]]:
    """A row for each run that is new, in order, and the state after them."""
    last, known, decided = state
    runs, out = runs.sort_values("run", kind="stable"), []  # of one ledger: one a day
    day = lambda c: (pd.to_datetime(runs[c]) - pd.Timestamp(0)).dt.days.tolist()
    date = lambda n: None if n == _NEVER else (pd.Timestamp(0) + pd.Timedelta(days=n)).date()
    for run, end, market, today, errors in zip(runs["run"].tolist(), day("end"), day("market_day"), day("today"), runs["errors"].tolist()):
        if run <= last:
            continue
        status, known, decided = settle(end, market, today, errors, known, decided)
        last = run
        out.append((ledger, run, status, date(known), date(decided)))
    return pd.DataFrame(out, columns=["ledger", "run", "status", "market_day", "decision_day"]), (last, known, decided)


class Updater(StatefulProcessor):
    """State: the last run's number, the latest market day and the latest decision day of a ledger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else _START
        out, after = _walk(key[0], pd.concat(list(rows)), before)
        self.state.update(after)
        yield out

    def close(self) -> None:
        pass


def updates(runs: DataFrame) -> DataFrame:
    """A row for each new run of (ledger, run, end, market_day, today, errors); a batch starts without state."""
    by_ledger = runs.select("ledger", "run", "end", "market_day", "today", "errors").groupBy("ledger")
    if runs.isStreaming:
        return by_ledger.transformWithStateInPandas(Updater(), _OUT, "Append", "None")
    return by_ledger.applyInPandas(lambda key, rows: _walk(key[0], rows, _START)[0], _OUT)


def update_stream(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the status of each run to the Parquet table at ``path``, once, whatever is replayed; needs the RocksDB state store."""
    return updates(runs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
