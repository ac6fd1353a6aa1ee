"""Table functions for SQL: register_tables() makes merge_intervals and judge_items known to a session.

    SELECT * FROM merge_intervals(TABLE(SELECT user_id AS key, s, e FROM x) PARTITION BY key ORDER BY (s, e))
    SELECT b.batch, j.* FROM b, LATERAL judge_items(b.text, b.ids) j
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

VERDICTS = ("correct", "incorrect", "uncertain")


class MergeIntervals:
    """(key, s, e, n) of a partition's intervals, in order of s and e, merged where they overlap strictly.
    One interval at a time is held, however many a key has."""

    def __init__(self):
        self.now = None

    def eval(self, row) -> Iterator[tuple]:
        key, s, e = row["key"], row["s"], row["e"]
        if self.now and self.now[0] == key and s < self.now[2]:
            self.now = (key, self.now[1], max(self.now[2], e), self.now[3] + 1)
            return
        if self.now:
            yield self.now
        self.now = (key, s, e, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.now:
            yield self.now


class JudgeItems:
    """(id, verdict, reason, parse_ok), one for each expected id, of a judge's JSON: an unknown or repeated id
    makes the whole batch uncertain, a missing or ill-formed item itself. 1 to 4 distinct ids, else an error."""

    def eval(self, text: str, expected: list[str]) -> Iterator[tuple]:
        if not 1 <= len(expected) <= 4 or len(set(expected)) != len(expected):
            raise ValueError("a judge's batch has one to four distinct ids")
        found, error = {}, None
        try:
            for item in self.items(text):
                name = item.get("id") if isinstance(item, dict) else None
                if not isinstance(name, str) or name not in expected or name in found:
                    raise ValueError("unknown or repeated id")
                verdict, reason = item.get("verdict"), item.get("reason")
                good = isinstance(verdict, str) and verdict in VERDICTS and isinstance(reason, str) and reason.strip()
                found[name] = (name, verdict, reason.strip(), True) if good else (name, "uncertain", "ill-formed item", False)
        except ValueError as e:
            error = str(e)
        for name in expected:
            yield found[name] if not error and name in found else (name, "uncertain", error or "missing item", False)

    @staticmethod
    def items(text: str | None) -> list:
        """The results of one JSON object, in one fence at most."""
        clean = (text or "").strip()
        for head in ("```json\n", "```\n"):
            if clean.startswith(head) and clean.endswith("```") and len(clean) >= len(head) + 3:
                clean = clean[len(head) : -3].strip()
                break
        value = json.loads(clean)
        rows = value.get("results") if isinstance(value, dict) else None
        if not isinstance(rows, list):
            raise ValueError("no list of results")
        return rows


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("merge_intervals", udtf(MergeIntervals, returnType="key long, s double, e double, n long"))
    spark.udtf.register("judge_items", udtf(JudgeItems, returnType="id string, verdict string, reason string, parse_ok boolean"))
