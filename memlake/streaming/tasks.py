"""Task life cycle as a keyed state machine: transitions and time spent per status."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "id long, change_id long, changed_at timestamp, from_status string, to_status string, "
    "seconds_in_status double, completed_at timestamp"
)


class TaskLife(StatefulProcessor):
    """State of a task: its status, since when, and when it was last completed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("task", "status string, since timestamp, completed timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (task,) = key
        status, since, completed = self._state.get() if self._state.exists() else (None, None, None)
        changes = sorted(rows, key=lambda r: (r.changed_at is None, r.changed_at, r.change_id is None, r.change_id))
        for change in changes:
            if change.op == "insert":
                target, done = change.status, None
            elif status is None:
                continue  # changes of a task that is not alive do nothing
            elif change.op == "delete":
                target, done = None, None
            elif change.op == "complete":
                target, done = "done", change.changed_at
            elif change.set_fields is not None and "status" in list(change.set_fields):
                target, done = change.status, completed
            else:
                continue
            seconds = (change.changed_at - since).total_seconds() if since is not None and change.changed_at is not None else None
            yield Row(id=task, change_id=change.change_id, changed_at=change.changed_at, from_status=status, to_status=target,
                      seconds_in_status=seconds, completed_at=done)
            if target != status:
                since = change.changed_at
            status, completed = target, done
            if status is None:
                since = None
        if status is None:
            self._state.clear()
        else:
            self._state.update((status, since, completed))

    def close(self) -> None:
        pass


def task_transitions(stream: DataFrame) -> DataFrame:
    """Transitions of (id, change_id, changed_at, op, set_fields, status); needs the RocksDB state store."""
    return stream.groupBy("id").transformWithState(
        statefulProcessor=TaskLife(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
