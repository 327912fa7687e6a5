"""As many tasks as the rows need.

Adaptive execution joins small partitions until each core has one, so a task's rows, and
what it sorts or counts at a time, grow with the input. A number of partitions that is
asked for stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task gets, about.
TASK_ROWS = 1 << 17


def tasks_for(*frames: DataFrame) -> int:
    """Tasks for the rows of all frames. They are counted when called."""
    return max(1, -(-sum(df.count() for df in frames) // TASK_ROWS))
