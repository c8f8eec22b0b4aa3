"""Facts from a stream of change events: the state machine with state, late events kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.facts import KEY

LOG = "tenant string, source string, entity_id string, field string, arrival long, valid_from long, value string, outcome string, valid_to long, superseded_by long, closes long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Log rows of one key's new events; the state is its current version (arrival, valid_from, value)."""
    now = state.get if state.exists else None
    rows = []
    events = pd.concat(list(frames)).sort_values("arrival")
    for arrival, valid_from, value in zip(events["arrival"].tolist(), events["valid_from"].tolist(), events["value"].tolist(), strict=True):
        if now is None:
            rows.append((*key, arrival, valid_from, value, "inserted", None, None, None))
        elif value == now[2]:
            continue
        elif valid_from <= now[1]:
            rows.append((*key, arrival, valid_from, value, "stale", now[1], now[0], None))
            continue
        else:
            rows.append((*key, arrival, valid_from, value, "superseded", None, None, now[0]))
        now = (arrival, valid_from, value)
    if now is not None:
        state.update(now)
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])
    for c in ("valid_to", "superseded_by", "closes"):
        out[c] = out[c].astype("Int64")
    yield out


def fact_log(events: DataFrame) -> DataFrame:
    """An append-only log of what each event of a stream did. No watermark: late events are history, never dropped."""
    rows = events.select(*KEY, "arrival", "valid_from", "value")
    return rows.groupBy(*KEY).applyInPandasWithState(_step, LOG, "arrival long, valid_from long, value string", "append", GroupStateTimeout.NoTimeout)


def versions_of(log: DataFrame) -> DataFrame:
    """Fact versions from the log: what a later row closes ends where that row begins."""
    ends = log.where("closes IS NOT NULL").select(*KEY, F.col("closes").alias("arrival"), F.col("valid_from").alias("end"), F.col("arrival").alias("by"))
    rows = log.join(ends, [*KEY, "arrival"], "left")
    return rows.select(*KEY, "arrival", "valid_from", "value", F.coalesce("valid_to", "end").alias("valid_to"), F.coalesce("superseded_by", "by").alias("superseded_by"), "outcome")
