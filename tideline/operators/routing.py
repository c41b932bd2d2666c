"""Fan-out of records to sinks, settlement of outcomes, and differences between sink configurations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Filter, event_type_allowed, with_matches
from ..functions.text import canonical_json
from .matching import route_by_index


@dataclass(frozen=True)
class Sink:
    """A sink's configuration. Type and spec are its identity; filter and event types may change while it runs."""

    id: str
    collection: str
    type: str
    spec: dict = field(default_factory=dict, hash=False)
    event_types: tuple[str, ...] = ()
    filter: Filter = field(default_factory=Filter, hash=False)

    def rule(self) -> tuple:
        """Sinks of one rule accept the same records."""
        return self.collection, tuple(sorted(t.upper() for t in self.event_types)), canonical_json(self.filter.config())


def _told(records: DataFrame, sinks: list[Sink]) -> tuple[DataFrame, list[tuple[Column, list[str]]]]:
    """Records with what the sinks' filters share, and for each distinct rule its test and its sinks. Cheaper tests come first."""
    rules: dict[tuple, list[Sink]] = {}
    for s in sinks:
        rules.setdefault(s.rule(), []).append(s)
    df, matches = with_matches(records, [of[0].filter for of in rules.values()])
    tests = [(F.col("tableName") == of[0].collection) & event_type_allowed(F.col("recordType"), list(of[0].event_types)) & m for of, m in zip(rules.values(), matches, strict=True)]
    return df, [(t, [s.id for s in of]) for t, of in zip(tests, rules.values(), strict=True)]


#: Rules up to which each is a Column of its own; the index over more gives the same rows.
MANY_RULES = 64


def route(records: DataFrame, sinks: list[Sink]) -> DataFrame:
    """A row for each record and each sink of its collection that accepts it, with sinkId. One pass for all sinks; no sinks, no rows.

    What filters ask of the images is extracted once for all sinks. Many rules
    are looked up in an index, whose plan does not grow with them.
    """
    if len({s.rule() for s in sinks}) > MANY_RULES:
        return route_by_index(records, sinks)
    df, tests = _told(records, sinks)
    hits = [F.when(t, F.array(*map(F.lit, ids))) for t, ids in tests]
    chosen = F.flatten(F.array_compact(F.array(*hits))) if hits else F.expr("cast(array() as array<string>)")
    return df.withColumn("sinkId", F.explode(chosen)).select(*records.columns, "sinkId")


def any_route(records: DataFrame, sinks: list[Sink]) -> DataFrame:
    """Records that some sink accepts, once: several sinks on one destination are an OR."""
    df, tests = _told(records, sinks)
    return df.where(reduce(or_, (t for t, _ in tests), F.lit(False))).select(*records.columns)


def failures(outcomes: DataFrame) -> DataFrame:
    """eventId, error of the events of which a delivery failed."""
    return outcomes.where(~F.col("ok")).groupBy("eventId").agg(F.max("error").alias("error"))


def settle(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """eventId, settled, error: whether all deliveries of an event succeeded. Events that no sink took are settled."""
    bad = failures(outcomes).withColumn("_bad", F.lit(True))
    return events.select("eventId").distinct().join(bad, "eventId", "left").select("eventId", F.col("_bad").isNull().alias("settled"), "error")


def settlement(settled: DataFrame, queued: DataFrame) -> DataFrame:
    """eventId, state of each event: delivered, queued for a retry, or unsettled, which is delivered again."""
    q = queued.select("eventId", F.lit(True).alias("_q")).distinct()
    state = F.when(F.col("settled"), "delivered").when(F.col("_q"), "queued").otherwise("unsettled")
    return settled.join(q, "eventId", "left").select("eventId", state.alias("state"))


def reconcile(current: DataFrame, desired: DataFrame) -> DataFrame:
    """id, change: removed, added, or updated where filter or event types differ. Both: id, filter, eventTypes (canonical text)."""
    c = current.select(F.col("id"), F.struct("filter", "eventTypes").alias("was"))
    d = desired.select(F.col("id"), F.struct("filter", "eventTypes").alias("now"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("now")), "updated")
    return c.join(d, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def reconcile_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "updated")))


class Sinks:
    """The sinks that a running stream uses, read once for each batch. A failed load keeps the last good ones."""

    def __init__(self, load):
        self.load, self.active = load, {}

    def register(self, sink: Sink) -> None:
        self.active[sink.id] = sink

    def remove(self, sink_id: str) -> bool:
        return self.active.pop(sink_id, None) is not None

    def clear(self) -> None:
        self.active = {}

    def count(self) -> int:
        return len(self.active)

    def apply(self, desired: list[Sink]) -> dict[str, list[str]]:
        """Make the active sinks the desired ones. A sink whose filter or event types changed keeps its place; type and spec never change."""
        now = {s.id: s for s in desired}
        differ = lambda a, b: a.event_types != b.event_types or a.filter != b.filter
        changes = {"removed": [i for i in self.active if i not in now], "added": [i for i in now if i not in self.active], "updated": [i for i in now if i in self.active and differ(self.active[i], now[i])]}
        self.active = {i: (s if i not in self.active or i in changes["updated"] else self.active[i]) for i, s in now.items()}
        return changes

    def refresh(self) -> list[Sink]:
        try:
            self.apply(self.load())
        except Exception:
            if not self.active:
                raise
        return list(self.active.values())
