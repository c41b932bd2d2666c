"""Delivery metrics as tables: counters, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds in seconds.
DELIVERY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
WAIT_BUCKETS = tuple(0.001 * 2**n for n in range(16))


def counter(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """Rows of cumulative counts, le_0 and so on, with n and total, in one aggregation."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return df.groupBy(*labels).agg(*buckets, F.count(value).alias("n"), F.sum(value).alias("total"))


def delivery_sums(types: dict[str, list[str]]) -> list[Column]:
    """For DataFrame.observe on outcomes: of each sink type (with its sinks' ids) the deliveries by outcome, and the histogram of their seconds. Types are few, whatever the sinks."""
    out = []
    for kind, ids in types.items():
        own = F.col("sinkId").isin(ids)
        sums = {"success": F.count_if(own & F.col("ok")), "failure": F.count_if(own & ~F.col("ok")), "total": F.coalesce(F.sum(F.when(own, F.col("seconds"))), F.lit(0.0))}
        sums |= {f"le_{i}": F.count_if(own & (F.col("seconds") <= b)) for i, b in enumerate(DELIVERY_BUCKETS)}
        out += [x.alias(f"{kind}|{name}") for name, x in sums.items()]
    return out


class Delivered:
    """Deliveries by sink type, added up batch by batch from what the deliveries' own passes have observed."""

    def __init__(self):
        self.sums: dict[tuple[str, str], float] = {}

    def add(self, observed: dict) -> None:
        for key, n in observed.items():
            kind, name = key.rsplit("|", 1)
            self.sums[kind, name] = self.sums.get((kind, name), 0) + (n or 0)

    def counters(self) -> list[tuple[str, str, int]]:
        """(sink type, outcome, n) of all that happened."""
        return sorted((k, name, int(n)) for (k, name), n in self.sums.items() if name in ("success", "failure") and n)

    def histograms(self) -> list[tuple]:
        """(sink type, le_0, ..., n, total seconds)."""
        kinds = sorted({k for k, _ in self.sums})
        return [(k, *(int(self.sums[k, f"le_{i}"]) for i in range(len(DELIVERY_BUCKETS))), int(self.sums[k, "success"] + self.sums[k, "failure"]), self.sums[k, "total"]) for k in kinds]


def _series(name: str, labels: tuple[str, ...]):
    return F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *(F.concat(F.lit(f"{x}="), F.col(x)) for x in labels)), F.lit("} "))


def snapshot(values: DataFrame, name: str, *labels: str, value: str = "n") -> DataFrame:
    """Log lines of counters or gauges: name{label=value,...} n."""
    return values.select(F.concat(_series(name, labels), F.col(value).cast("string")).alias("line"))


def snapshot_histogram(histograms: DataFrame, name: str, *labels: str) -> DataFrame:
    """Log lines of histograms: name{label=value,...} count=n sum=total."""
    return histograms.select(F.concat(_series(name, labels), F.lit("count="), F.col("n").cast("string"), F.lit(" sum="), F.round("total", 6).cast("decimal(38,6)").cast("string")).alias("line"))


def without_lane(series: DataFrame, collection: str, sink_id: str) -> DataFrame:
    """Series without those of a sink that was removed."""
    return series.where(~((F.col("collection") == collection) & (F.col("sinkId") == sink_id)))


class Refreshed:
    """A sampled gauge: a failed sample keeps the value before it."""

    def __init__(self, sample, every: float = 15.0):
        self.sample, self.every, self.at, self.value = sample, every, None, None

    def read(self, now: float):
        if self.at is None or now - self.at >= self.every:
            self.at = now
            try:
                self.value = self.sample()
            except Exception:  # an old value is better than none
                pass
        return self.value
