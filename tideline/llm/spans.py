"""What scans return: spans of texts, and digests of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind, start, end (code points, end exclusive)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(joined(of_kinds(spans, kinds)), 256)


def count(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, (kind,))).cast("long")
