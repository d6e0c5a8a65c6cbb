"""Extension points: checks and judges that users bring along."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens import schema as S

CheckFunction = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Check:
    check_id: str
    name: str
    severity: str
    rule: str
    run: CheckFunction


class Registry:
    """User checks: functions of (docs, pages, spans) giving one row per document.

    A function returns ``doc_id`` and ``passed``, and may add ``applicable``,
    ``message``, ``details`` and ``pages``; the registry fills in the rest.
    """

    def __init__(self) -> None:
        self.checks: dict[str, Check] = {}

    def check(self, check_id: str, severity: str, rule: str, name: str | None = None):
        if severity not in R.SEVERITY_RANK:
            raise ValueError(f"unknown severity {severity!r}")

        def register(run: CheckFunction) -> CheckFunction:
            if check_id in self.checks:
                raise ValueError(f"check {check_id} is registered already")
            self.checks[check_id] = Check(check_id, name or run.__name__, severity, rule, run)
            return run
        return register

    def results(self, docs: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame | None:
        """Result rows of all registered checks, or None without any."""
        out = None
        for check in self.checks.values():
            rows = self._complete(check, check.run(docs, pages, spans))
            out = rows if out is None else out.unionByName(rows)
        return out

    @staticmethod
    def _complete(check: Check, rows: DataFrame) -> DataFrame:
        fixed = {"check_id": check.check_id, "name": check.name, "rule": check.rule,
                 "severity": check.severity}
        defaults = {"applicable": F.lit(True), "message": F.lit(""),
                    "details": F.lit(None).cast("string"),
                    "pages": F.lit(None).cast("array<int>"),
                    "items": F.lit(None).cast("array<string>")}
        rows = rows.withColumns({k: F.lit(v) for k, v in fixed.items()})
        rows = rows.withColumns({k: v for k, v in defaults.items() if k not in rows.columns})
        return rows.select(*S.RESULT_COLUMNS)


def judge_with(requests: DataFrame,
               judge: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    """Answers of a user's judge over the request table, a batch at a time.

    ``judge`` gets a pandas batch of requests and returns one answer text for
    each; Spark decides partitioning and batch size.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "part_no": batch["part_no"], "answer": judge(batch)})

    return requests.mapInPandas(run, "doc_id long, part_no int, answer string")
