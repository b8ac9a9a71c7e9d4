"""Cursor pages over any DataFrame."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import CursorExpired


class Pages:
    """Pages of rows by a unique key; a cursor names the last key of a page and the table's generation."""

    def __init__(self, rows: DataFrame, key: str, generation: int):
        self.rows, self.key, self.generation = rows, key, generation

    def page(self, cursor: str | None, per_page: int = 1000) -> tuple[DataFrame, str | None]:
        """The rows after the cursor and the next cursor, None at the end."""
        rows = self.rows
        if cursor:
            got = json.loads(base64.b64decode(cursor))
            if got["generation"] != self.generation:
                raise CursorExpired("Cursor is not valid anymore")
            rows = rows.where(F.col(self.key) > F.lit(got["after"]))
        hits = rows.orderBy(self.key).limit(min(per_page, 1000))
        last, n = hits.agg(F.max(self.key), F.count(F.lit(1))).first()
        if n < min(per_page, 1000) or rows.where(F.col(self.key) > F.lit(last)).isEmpty():
            return hits, None
        return hits, base64.b64encode(json.dumps({"after": last, "generation": self.generation}).encode()).decode()
