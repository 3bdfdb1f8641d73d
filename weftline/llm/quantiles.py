"""Problem 7: percentiles of very large columns by mergeable sketches with relative rank error.

A sketch holds levels of relative compactors. Each compactor protects the half of its buffer at the accurate tail
and compacts a part of the other half, the longer the more seldom, so that the error of a rank is in proportion to
the distance from that tail. Sketches of days or files are rows of a table; merging adds buffers level by level.

The protected tail is the high one by default (``high=True``), with exact maximum; the low one mirrors it.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section size: the relative rank error is about 1.6 / K at two standard deviations.
K = 32
_SECTIONS = 3


class _Compactor:
    """One level, kept with values sorted when compacted; accurate at the high end."""

    def __init__(self, k: float, level: int):
        self.width, self.sections, self.state, self.level = float(k), _SECTIONS, 0, level
        self.parts: list[np.ndarray] = []
        self.size = 0

    def capacity(self) -> int:
        return 2 * self.sections * self.even()

    def even(self) -> int:
        return max(4, 2 * round(self.width / 2))

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.parts.append(values)
            self.size += len(values)

    def values(self) -> np.ndarray:
        if len(self.parts) != 1:
            self.parts = [np.concatenate(self.parts)] if self.parts else [np.zeros(0)]
        return self.parts[0]

    def compact(self) -> np.ndarray:
        """Takes values out of the low end and returns every second one for the next level."""
        held = np.sort(self.values())
        trailing = (~self.state & (self.state + 1)).bit_length() - 1
        free = min(trailing + 1, self.sections)
        keep = self.capacity() // 2 + (self.sections - free) * self.even()
        n = max(0, len(held) - keep)
        n -= n % 2
        coin = hashlib.blake2b(struct.pack("<qqd", self.level, self.state, float(held[n // 2]) if n else 0.0), digest_size=1).digest()[0] & 1
        up, rest = held[coin:n:2], held[n:]
        self.parts, self.size = [rest], len(rest)
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.width / math.sqrt(2) >= 4:
            self.width /= math.sqrt(2)
            self.sections *= 2
        return up


class RelativeSketch:
    """Quantile sketch of doubles; NaN is left out."""

    def __init__(self, k: int = K, high: bool = True):
        self.k, self.high, self.n = k, high, 0
        self.least, self.most = math.inf, -math.inf
        self.levels = [_Compactor(k, 0)]

    def update(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.float64)
        values = values[~np.isnan(values)]
        if not len(values):
            return
        self.n += len(values)
        self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
        signed = values if self.high else -values
        at = 0
        while at < len(signed):
            room = max(1, self.levels[0].capacity() - self.levels[0].size)
            self.levels[0].add(signed[at : at + room])
            at += room
            self._compress()

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            at = self.levels[level]
            if at.size >= at.capacity():
                if level + 1 == len(self.levels):
                    self.levels.append(_Compactor(self.k, level + 1))
                self.levels[level + 1].add(at.compact())
            level += 1

    def merge(self, other: RelativeSketch) -> None:
        """Takes in another sketch of the same kind."""
        if (self.k, self.high) != (other.k, other.high):
            raise ValueError("sketches of different kinds do not merge")
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        while len(self.levels) < len(other.levels):
            self.levels.append(_Compactor(self.k, len(self.levels)))
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.sections, mine.width = theirs.sections, theirs.width
            mine.add(theirs.values())
        self._compress()

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """The value at each share of the ranks (nearest rank); null of an empty sketch."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate([c.values() for c in self.levels])
        weights = np.concatenate([np.full(c.size, 1 << i, np.int64) for i, c in enumerate(self.levels)])
        if not self.high:
            values = -values
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        out = []
        for q in shares:
            if q <= 0 or q >= 1:
                out.append(self.least if q <= 0 else self.most)
                continue
            at = np.searchsorted(ranks, math.ceil(q * ranks[-1]))
            out.append(float(values[min(at, len(values) - 1)]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<ibqddi", self.k, self.high, self.n, self.least, self.most, len(self.levels))
        body = b"".join(struct.pack("<diqi", c.width, c.sections, c.state, c.size) + c.values().astype("<f8").tobytes() for c in self.levels)
        return head + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> RelativeSketch:
        k, high, n, least, most, count = struct.unpack_from("<ibqddi", raw)
        out = cls(k, bool(high))
        out.n, out.least, out.most, out.levels = n, least, most, []
        at = struct.calcsize("<ibqddi")
        for level in range(count):
            c = _Compactor(k, level)
            c.width, c.sections, c.state, size = struct.unpack_from("<diqi", raw, at)
            at += struct.calcsize("<diqi")
            c.add(np.frombuffer(raw, "<f8", size, at).copy())
            at += 8 * size
            out.levels.append(c)
        return out


HIGH, LOW = "high", "low"


class Summary:
    """What is known of a group: its values while they are fewer than a compactor holds, then a sketch per tail."""

    def __init__(self, k: int = K, tails: tuple[str, ...] = (HIGH, LOW)):
        self.k, self.tails, self.n = k, tails, 0
        self.room = 2 * _SECTIONS * k
        self.parts: list[np.ndarray] = []
        self.sketches: list[RelativeSketch] = []

    def add(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.float64)
        values = values[~np.isnan(values)]
        self.n += len(values)
        if self.sketches:
            for s in self.sketches:
                s.update(values)
            return
        self.parts.append(values)
        if self.n >= self.room:
            held, self.parts = np.concatenate(self.parts), []
            self.sketches = [RelativeSketch(self.k, tail == HIGH) for tail in self.tails]
            for s in self.sketches:
                s.update(held)

    def merge(self, other: Summary) -> None:
        if (self.k, self.tails) != (other.k, other.tails):
            raise ValueError("summaries of different kinds do not merge")
        if not other.sketches:
            for part in other.parts:
                self.add(part)
            return
        mine, self.parts = self.parts, []
        self.n += other.n
        if self.sketches:
            for s, o in zip(self.sketches, other.sketches, strict=True):
                s.merge(o)
        else:
            self.sketches = other.sketches
            for s in self.sketches:
                for part in mine:
                    s.update(part)

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Nearest ranks; shares below one half come from the sketch that protects the low tail, if there is one."""
        if not self.sketches:
            held = np.sort(np.concatenate(self.parts)) if self.n else np.zeros(0)
            return [float(held[min(max(math.ceil(q * self.n), 1), self.n) - 1]) if self.n else None for q in shares]
        by = dict(zip(self.tails, ([s.quantiles(shares) for s in self.sketches]), strict=True))
        pick = lambda q: HIGH if q >= 0.5 else LOW
        return [by.get(pick(q), by[self.tails[0]])[i] for i, q in enumerate(shares)]

    def ends(self) -> list[float | None]:
        """The least and the greatest value, which are exact."""
        if self.sketches:
            return [self.sketches[0].least, self.sketches[0].most]
        return [min(float(p.min()) for p in self.parts if len(p)), max(float(p.max()) for p in self.parts if len(p))] if self.n else [None, None]

    def to_bytes(self) -> bytes:
        names = "".join(t[0] for t in self.tails).encode()
        head = struct.pack("<iB", self.k, len(names)) + names
        if not self.sketches:
            return head + b"\0" + (np.concatenate(self.parts) if self.parts else np.zeros(0)).astype("<f8").tobytes()
        body = [s.to_bytes() for s in self.sketches]
        return head + b"\1" + b"".join(struct.pack("<i", len(b)) + b for b in body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Summary:
        k, size = struct.unpack_from("<iB", raw)
        names = raw[5 : 5 + size].decode()
        out = cls(k, tuple(HIGH if x == "h" else LOW for x in names))
        kind, at = raw[5 + size], 6 + size
        if not kind:
            out.add(np.frombuffer(raw, "<f8", offset=at).copy())
            return out
        for _ in names:
            (length,) = struct.unpack_from("<i", raw, at)
            out.sketches.append(RelativeSketch.from_bytes(raw[at + 4 : at + 4 + length]))
            at += 4 + length
        out.n = out.sketches[0].n
        return out


def build_sketches(df: DataFrame, groups: list[str], value: str, k: int = K, tails: tuple[str, ...] = (HIGH, LOW)) -> DataFrame:
    """One summary per group and task: the group columns (as strings), n and sketch.

    Null values are left out. Values meet their summary in the task that reads them, so a group that holds a third of
    all rows is spread as the rows are. Rows of a task are sorted by group, so that it takes a group's values at once
    and holds one group at a time.
    """
    rows = df.select(*(F.col(g).cast("string").alias(g) for g in groups), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    schema = ", ".join([*(f"`{g}` string" for g in groups), "n long", "sketch binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, summary, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], pa.string()) for i in range(len(groups))]
            columns += [pa.array([d[1].n for d in done], pa.int64()), pa.array([d[1].to_bytes() for d in done], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [*groups, "n", "sketch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(len(groups)).to_numpy(zero_copy_only=False)
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for i in range(len(groups)):
                codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            keys = list(zip(*(batch.column(i).take(pa.array(starts)).to_pylist() for i in range(len(groups))), strict=True)) if groups else [()]
            for key, start, end in zip(keys, starts, [*starts[1:], batch.num_rows], strict=True):
                if summary is None or key != held:
                    if summary is not None:
                        done.append((held, summary))
                    held, summary = key, Summary(k, tails)
                summary.add(values[start:end])
            if len(done) > 4000:
                yield out()
                done = []
        if summary is not None:
            done.append((held, summary))
        yield out()

    return rows.sortWithinPartitions(*groups).mapInArrow(run, schema) if groups else rows.mapInArrow(run, schema)


def _merged(rows: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Summaries of equal keys merged one after the other as they stream by in sorted partitions."""
    schema = ", ".join([*(f"`{g}` string" for g in groups), "n long", "sketch binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, summary, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], pa.string()) for i in range(len(groups))]
            columns += [pa.array([d[1].n for d in done], pa.int64()), pa.array([d[1].to_bytes() for d in done], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [*groups, "n", "sketch"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, raw in zip(*columns, strict=True):
                part = Summary.from_bytes(raw)
                if summary is not None and key == held:
                    summary.merge(part)
                    continue
                if summary is not None:
                    done.append((held, summary))
                held, summary = key, part
            if len(done) > 2000:
                yield out()
                done = []
        if summary is not None:
            done.append((held, summary))
        yield out()

    ordered = rows.select(*keys, "sketch", "n").repartition(*keys).sortWithinPartitions(*keys, "n", "sketch")
    return ordered.mapInArrow(run, schema)


def merge_sketches(sketches: DataFrame, groups: list[str], fan_in: int = 16) -> DataFrame:
    """One summary per group, merged in two rounds so that no task takes all summaries of a large group.

    A task holds one summary at a time; those of a group come in an order of their own, so that a merge repeats. Where
    there are many groups of which each has few summaries, ``fan_in`` 1 saves the first round.
    """
    if fan_in == 1:
        return _merged(sketches, groups, groups)
    salted = sketches.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)).cast("string"))
    return _merged(_merged(salted, [*groups, "_salt"], groups), groups, groups)


def share_name(share: float) -> str:
    """p50, p99_9, ... for a share."""
    return "p" + f"{100 * share:g}".replace(".", "_")


def read_quantiles(sketches: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """Group columns, n, least, most and one column per share (p50, p99_9, ...), of one summary per group."""
    measures = ["n", "least", "most", *map(share_name, shares)]
    schema = ", ".join([*(f"`{g}` string" for g in groups), "n long", *(f"`{n}` double" for n in measures[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [Summary.from_bytes(raw) for raw in batch.column(len(groups)).to_pylist()]
            values = [[p.n, *p.ends(), *p.quantiles(shares)] for p in parts]
            columns = [batch.column(i) for i in range(len(groups))]
            columns += [pa.array([v[i] for v in values], pa.float64() if i else pa.int64()) for i in range(len(measures))]
            yield pa.RecordBatch.from_arrays(columns, [*groups, *measures])

    return sketches.select(*groups, "sketch").mapInArrow(run, schema)


def percentiles(rows: DataFrame, groups: list[str], value: str, shares: list[float], k: int = K, fan_in: int = 16) -> DataFrame:
    """Percentiles per group, those below one half from sketches that protect the low tail, the others the high one."""
    return read_quantiles(merge_sketches(build_sketches(rows, groups, value, k), groups, fan_in), groups, shares)


def rank_errors(rows: DataFrame, found: DataFrame, groups: list[str], value: str, shares: list[float], bound: float = 3.2 / K) -> DataFrame:
    """The groups, share, n, and within: whether the rank of a reported percentile is off by at most ``bound`` of the
    distance to the nearer end, and one. ``found``: one row per group, as ``percentiles`` gives it; a small table."""
    each = found.select(*groups, F.inline(F.array(*(F.struct(F.lit(share_name(q)).alias("share"), F.lit(q).alias("_q"), F.col(share_name(q)).alias("_at")) for q in shares))))
    listed = each.groupBy(*groups).agg(F.collect_list(F.struct("share", "_q", "_at")).alias("_l"))  # one entry per share
    joined = rows.select(*(F.col(g).cast("string").alias(g) for g in groups), F.col(value).alias("_v")).join(listed, groups).select(*groups, "_v", F.inline("_l"))
    counted = joined.groupBy(*groups, "share", "_q").agg(F.count("*").alias("n"), F.count_if(F.col("_v") < F.col("_at")).alias("_less"), F.count_if(F.col("_v") <= F.col("_at")).alias("_most"))
    wanted = F.ceil(F.col("_q") * F.col("n"))
    off = F.greatest(F.lit(0), F.col("_less") + 1 - wanted, wanted - F.col("_most"))
    near = F.when(F.col("_q") >= 0.5, F.col("n") - wanted + 1).otherwise(wanted)
    return counted.select(*groups, "share", "n", (off <= bound * near + 1).cast("int").alias("within"))


def metric_rows(evaluations: DataFrame) -> DataFrame:
    """Domain, day, metric and value of each distinct evaluation; missing maps, keys and values are left out."""
    from weftline.schema import domain

    rows = evaluations.select("eval_id", domain("domain").alias("domain"), F.to_date("scored_at").cast("string").alias("day"), "metrics")
    rows = rows.filter("eval_id IS NOT NULL AND metrics IS NOT NULL").dropDuplicates(["eval_id"])
    return rows.select("domain", "day", F.explode("metrics").alias("metric", "value")).filter("value IS NOT NULL")
