"""Table functions for SQL: generated invites with credits kept along a user's requests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class GeneratedInvites:
    """``generated_invites(TABLE(requests) PARTITION BY user ORDER BY time)``: one row per request that has credit left.

    Requests have user_id, request_id, credits and code; a user's first row says how many credits there are. A
    code is trimmed and in capitals; requests beyond the credits, and those of a null code, give a row without
    code (``granted`` false). State is one number per user, whatever the number of requests."""

    def __init__(self) -> None:
        self.left: int | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.left is None:
            self.left = row["credits"] or 0
        granted = self.left > 0 and row["code"] is not None
        self.left -= granted
        yield row["user_id"], row["request_id"], row["code"].strip().upper() if granted else None, self.left, granted


def register_invites(spark: SparkSession, name: str = "generated_invites") -> None:
    """Makes the table function callable from SQL, with a table argument or laterally."""
    function = udtf(GeneratedInvites, returnType="user_id long, request_id long, code string, remaining int, granted boolean")
    spark.udtf.register(name, function)
