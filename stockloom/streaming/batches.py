"""Results of micro-batches, stored so that a batch that runs again leaves the same result.

A batch overwrites its own folder, whatever a failed first attempt left there. State that later batches
read and change is in ``sources.keyed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_path(folder, batch_id))


def _path(folder: str, batch_id: int) -> str:
    return f"{folder}/batch-{batch_id:012d}"
