"""Stateful streams: action replay per document, latest state per job.

Both keep one small state row per key and emit as events arrive; their batch forms in
``review.replay_actions`` and ``jobs.latest`` are the reference for their results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPLAY_SCHEMA = "doc_id bigint, override_id string, expected_version bigint, accepted boolean, revision bigint"


def _replay(key, batches: Iterator[pd.DataFrame], state: GroupState):
    revision = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["created_at", "override_id"])
    out = []
    for oid, expected in zip(rows["override_id"], rows["expected_version"]):
        ok = int(expected) == revision
        revision += ok
        out.append((key[0], oid, int(expected), bool(ok), revision))
    state.update((revision,))
    yield pd.DataFrame(out, columns=["doc_id", "override_id", "expected_version", "accepted", "revision"])


def replay_stream(actions: DataFrame) -> DataFrame:
    """Accept an action when its expected version is the document's revision, in arrival order."""
    return actions.groupBy("doc_id").applyInPandasWithState(
        _replay, REPLAY_SCHEMA, "revision bigint", "append", GroupStateTimeout.NoTimeout
    )


def latest_job_stream(events: DataFrame) -> DataFrame:
    """Latest state per job as an update-mode aggregate; partial aggregation is built in."""
    from pyspark.sql import functions as F

    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("updated_at", "event_id")).alias("status"),
        F.max("updated_at").alias("updated_at"), F.count("*").alias("events"),
    )
