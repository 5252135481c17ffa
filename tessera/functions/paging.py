"""Pages: by keyset, by offset, and over revisions; cursors are opaque texts."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import sort_columns

Parts = list[tuple[Column, bool]]


@dataclass
class Page:
    rows: DataFrame
    take: int
    has_previous: bool

    def edges(self) -> tuple[list, bool]:
        """Rows of the page, and whether more follow (one more row was asked for)."""
        got = self.rows.collect()
        return got[: self.take], len(got) > self.take


def sort_hash(order: list[dict] | None) -> str:
    return hashlib.sha256(json.dumps(order or [], sort_keys=True).encode()).hexdigest()[:16]


def encode_cursor(values: list, order: list[dict] | None) -> str:
    return base64.urlsafe_b64encode(json.dumps([values, sort_hash(order)]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None, order: list[dict] | None) -> list | None:
    """Values of a cursor; none for a malformed one or one of another order, which gives the first page."""
    try:
        values, made = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return values if made == sort_hash(order) and isinstance(values, list) else None
    except Exception:
        return None


def after(parts: Parts, values: list) -> Column:
    """Rows past a place in the order: (a, b, ...) after (x, y, ...), part by part; missing values are the largest."""
    out, same = F.lit(False), F.lit(True)
    for (c, up), v in zip(parts, values, strict=True):
        if v is None:
            past = F.lit(False) if up else c.isNotNull()
            equal = c.isNull()
        else:
            past = (c.isNull() | (c > F.lit(v))) if up else (c < F.lit(v))
            equal = c == F.lit(v)
        out = out | (same & F.coalesce(past, F.lit(False)))
        same = same & F.coalesce(equal, F.lit(False))
    return out


def keyset_page(rows: DataFrame, parts: Parts, take: int, cursor_values: list | None) -> Page:
    """`take` rows past the cursor, and one more to look ahead; a top-k, as the filter and the limit reach the sort."""
    if cursor_values is not None and len(cursor_values) == len(parts):
        rows = rows.filter(after(parts, cursor_values))
    else:
        cursor_values = None
    return Page(rows.orderBy(*sort_columns(parts)).limit(take + 1), take, cursor_values is not None)


def offset_page(rows: DataFrame, order: list[Column], first: int, cursor: str | None = None) -> DataFrame:
    """Rows after an absolute position; cursors are positions from 1 on."""
    if first < 0:
        raise ValueError("first must not be negative")
    if cursor is not None and not (re.fullmatch(r"\d+", cursor) and int(cursor) < 1 << 53):
        raise ValueError("after must be a whole number")
    return rows.orderBy(*order).offset(int(cursor or 0)).limit(first)


def revision_page(revisions: DataFrame, take: int, after: int | None = None, before: int | None = None, inclusive: bool = False) -> DataFrame:
    """Revisions by sequence; a negative take reads backward. Only one of after and before may be given."""
    if after is not None and before is not None:
        raise ValueError("after and before exclude each other")
    s = F.col("sequence")
    if after is not None:
        revisions = revisions.filter(s >= after if inclusive else s > after)
    if before is not None:
        revisions = revisions.filter(s <= before if inclusive else s < before)
    back = take < 0 or (before is not None and take > 0)
    return revisions.orderBy(s.desc() if back else s.asc()).limit(abs(take)).orderBy(s)


def with_ties(rows: DataFrame, by: Column, n: int) -> DataFrame:
    """The first n rows by a column, and all that tie with the last: the n-th value bounds a plain filter."""
    last = rows.orderBy(by).limit(n).agg(F.max(by).alias("last"))
    return rows.join(F.broadcast(last), by <= F.col("last")).drop("last")  # one row
