"""Where intermediate tables live between the steps of a plan.

A *stage* is a function ``(name, frame) -> frame``.  The steps call it on the
few narrow tables that several later branches read, so that a cluster job
computes them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

Stage = Callable[[str, DataFrame], DataFrame]


def inline(name: str, df: DataFrame) -> DataFrame:
    """No stage: the branches recompute what they need, fully column-pruned."""
    return df


class Kept:
    """Executor storage, spilling to disk; lost blocks are recomputed.

    ``with Kept() as stage: ...`` gives the storage back at the end, as does ``release``.
    """

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.frames[-1]

    def release(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *error) -> None:
        self.release()


def parquet_stage(folder: str) -> Stage:
    """Written tables in a shared folder: lineage ends there, losses do not hurt."""
    def stage(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return stage
