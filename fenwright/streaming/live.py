"""The same semantics on unbounded input: Structured Streaming with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def downsample(stream: DataFrame, aggregate: Column, width: str, delay: str, ts: str = "ts", key: str = "key") -> DataFrame:
    """Tumbling buckets per key, emitted once the watermark has passed them; later samples do not change them."""
    return stream.withWatermark(ts, delay).groupBy(key, F.window(ts, width).alias("w")).agg(aggregate.alias("value")).select(key, F.col("w.start").alias("bucket"), "value")


def once(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Idempotency: the first row of each key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rate_limit(stream: DataFrame, capacity: float, rate: float, key: str = "key", ts: str = "ms") -> DataFrame:
    """Token bucket per key: `rate` tokens a second up to `capacity`; allowed is whether the request got its token."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(parts)).sort_values(ts)
        out = []
        for t in rows[ts]:
            left = capacity if last is None else min(capacity, left + max(0, t - last) * rate / 1000)
            last = t if last is None else max(last, t)
            ok = left >= 1
            left -= ok
            out.append((k[0], t, bool(ok)))
        state.update((float(left), int(last)))
        yield pd.DataFrame(out, columns=[key, ts, "allowed"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, {ts} long, allowed boolean", "left double, last long", "append", GroupStateTimeout.NoTimeout)


def consumer_group(stream: DataFrame, key: str = "key") -> DataFrame:
    """A log and its acknowledgements (kind `add` or `ack`, ms, seq) as events of one group: emits the number pending per key."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(map(tuple, zip(*state.get, strict=True))) if state.exists else set()
        for p in parts:
            for kind, ms, seq in zip(p["kind"], p["ms"], p["seq"], strict=True):
                (held.add if kind == "add" else held.discard)((int(ms), int(seq)))
        ids = sorted(held)
        state.update(([a for a, _ in ids], [b for _, b in ids]))
        yield pd.DataFrame([(k[0], len(ids))], columns=[key, "pending"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, pending long", "ms array<long>, seq array<long>", "update", GroupStateTimeout.NoTimeout)
