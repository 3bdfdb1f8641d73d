"""Problem 2: one consistent form of whole Arrow columns, without a string call per row.

The texts of an Arrow batch become one numpy array of code points. A lookup table gives each code point's
expansion length and place, so that a gather writes the decomposed and levelled text; marks are then put in
canonical order and composed with their base by sorted-table lookups, one mark rank at a time for all rows.

Nulls stay null, empty texts stay empty. Texts of plain ASCII without tabs, carriage returns or vertical
separators are their own form and skip the table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.charforms import level_map
from weftline.session import checkpoint

_SIZE = 0x110000
_S_BASE, _L_BASE, _V_BASE, _T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7


class FoldTables:
    """Lookup tables by code point: expansion (length, offset, data), combining class, and composition pairs."""

    def __init__(self) -> None:
        level = level_map()
        self.length = np.ones(_SIZE, np.uint8)
        self.single = np.arange(_SIZE, dtype=np.uint32)
        self.start = np.zeros(_SIZE, np.int32)
        self.ccc = np.zeros(_SIZE, np.uint8)
        data: list[int] = []
        pairs: dict[int, int] = {}
        for code in [*range(0x80, 0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
            ch = chr(code)
            if (order := unicodedata.combining(ch)) != 0:
                self.ccc[code] = order
            form = unicodedata.normalize("NFD", ch)
            if len(form) > 1 and unicodedata.normalize("NFC", ch) == ch and not 0xAC00 <= code < 0xD7A4:
                first, second = (int(x, 16) for x in unicodedata.decomposition(ch).split())
                pairs[first << 21 | second] = code
            to = form.translate(level)
            if to != ch:
                self._put(code, to, data)
        for code, to in level.items():
            self._put(code, "".join(level.get(ord(x), x) for x in unicodedata.normalize("NFD", to)), data)
        self.data = np.array(data or [0], np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        # code points that are not their own form wherever they stand
        self.odd = (self.length != 1) | (self.single != np.arange(_SIZE)) | (self.ccc > 0)
        self.odd[13] = True
        self.odd[[k & 0x1FFFFF for k in pairs]] = True
        self.odd[_V_BASE : _T_BASE + 28] = True

    def _put(self, code: int, to: str, data: list[int]) -> None:
        self.length[code] = len(to)
        self.start[code] = len(data)
        self.single[code] = ord(to) if len(to) == 1 else 0
        data.extend(map(ord, to))


@lru_cache(maxsize=1)
def tables() -> FoldTables:
    return FoldTables()


def _lookup(t: FoldTables, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composite of each pair, or 0."""
    key = first.astype(np.int64) << 21 | second.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    return np.where(t.pair_keys[at] == key, t.pair_to[at], np.uint32(0))


def _drop(codes: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return codes[keep], before[offsets]


def _compose(t: FoldTables, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of all marks; a mark never joins a base of another row."""
    ccc = t.ccc[codes]
    marks = np.flatnonzero(ccc)
    if not len(marks):
        return codes, offsets
    row_start = np.zeros(len(codes), bool)
    row_start[offsets[:-1][offsets[:-1] < len(codes)]] = True
    fresh = (np.diff(marks, prepend=-2) != 1) | row_start[marks]  # the first mark of a run
    run = np.cumsum(fresh) - 1
    head = marks[fresh]
    order = np.lexsort((ccc[marks], run))  # stable by class in each run
    codes = codes.copy()
    codes[marks] = codes[marks[order]]
    ccc = t.ccc[codes]
    rank = np.arange(len(marks)) - np.flatnonzero(fresh)[run]
    has_base = (head > 0) & ~row_start[head]
    base = np.where(has_base, head - 1, 0)
    last = np.zeros(len(head), np.int16)  # class of the last mark left standing in the run
    keep = np.ones(len(codes), bool)
    for r in range(int(rank.max()) + 1):
        at = marks[rank == r]
        of = run[rank == r]
        free = has_base[of] & (last[of] < ccc[at])
        to = np.where(free, _lookup(t, codes[base[of]], codes[at]), np.uint32(0))
        hit = to > 0
        codes[base[of[hit]]] = to[hit]
        keep[at[hit]] = False
        last[of[~hit]] = ccc[at[~hit]]
    return _drop(codes, offsets, keep)


def _compose_adjacent(t: FoldTables, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two starters: Hangul letters, and the few others of the pair table."""
    row_start = np.zeros(len(codes) + 1, bool)
    row_start[offsets] = True
    wide = np.flatnonzero((codes[1:] >= 0x900) & (t.ccc[codes[1:]] == 0) & ~row_start[1:-1]) + 1
    if not len(wide):
        return codes, offsets
    first, second = codes[wide - 1].astype(np.int64), codes[wide].astype(np.int64)
    lv = (first >= _L_BASE) & (first < _L_BASE + 19) & (second >= _V_BASE) & (second < _V_BASE + 21)
    if lv.any():
        codes = codes.copy()
        codes[wide[lv] - 1] = _S_BASE + ((first[lv] - _L_BASE) * 21 + second[lv] - _V_BASE) * 28
        keep = np.ones(len(codes), bool)
        keep[wide[lv]] = False
        codes, offsets = _drop(codes, offsets, keep)
        row_start = np.zeros(len(codes) + 1, bool)
        row_start[offsets] = True
    while len(codes) > 1:
        one, two = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        lvt = (one >= _S_BASE) & (one < _S_BASE + 11172) & ((one - _S_BASE) % 28 == 0) & (two > _T_BASE) & (two < _T_BASE + 28)
        to = np.where(lvt, one + two - _T_BASE, 0)
        starters = np.flatnonzero((two >= 0x900) & (t.ccc[two] == 0))
        to[starters] = np.where(to[starters] > 0, to[starters], _lookup(t, one[starters], two[starters]))
        hit = np.flatnonzero((to > 0) & ~row_start[1:-1])
        hit = hit[np.diff(hit, prepend=-2) > 1]
        if not len(hit):
            break
        codes = codes.copy()
        codes[hit] = to[hit]
        keep = np.ones(len(codes), bool)
        keep[hit + 1] = False
        codes, offsets = _drop(codes, offsets, keep)
        row_start = np.zeros(len(codes) + 1, bool)
        row_start[offsets] = True
    return codes, offsets


def fold_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of rows given as code points and row offsets."""
    t = tables()
    if not len(codes):
        return codes, offsets
    returns = np.flatnonzero(codes == 13)
    if len(returns):
        codes = codes.copy()
        codes[returns] = 10
        row_end = np.zeros(len(codes) + 1, bool)
        row_end[offsets] = True
        paired = returns[returns + 1 < len(codes)]
        paired = paired[(codes[paired + 1] == 10) & ~np.isin(paired + 1, returns) & ~row_end[paired + 1]]
        keep = np.ones(len(codes), bool)
        keep[paired] = False
        codes, offsets = _drop(codes, offsets, keep)
    length = t.length[codes]
    if (length == 1).all():
        codes = t.single[codes]
    else:
        ends = np.cumsum(length, dtype=np.int64)
        starts = ends - length
        out = np.empty(int(ends[-1]), np.uint32)
        one = length == 1
        out[starts[one]] = t.single[codes[one]]
        many = length > 1
        if many.any():
            n = length[many].astype(np.int64)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(starts[many], n) + within] = t.data[np.repeat(t.start[codes[many]].astype(np.int64), n) + within]
        offsets = np.concatenate([[0], ends])[offsets]
        codes = out
    codes, offsets = _compose(t, codes, offsets)
    before = len(codes)
    if before > 1:
        codes, offsets = _compose_adjacent(t, codes, offsets)
    return _compose(t, codes, offsets) if len(codes) < before else (codes, offsets)


def to_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of an Arrow string array; a null counts as empty."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    try:
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:  # a broken transfer; such bytes become U+FFFD row by row
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    return codes, first[ends]


def from_codes(codes: np.ndarray, offsets: np.ndarray, nulls: pa.Array | None = None) -> pa.Array:
    """The Arrow string array of code points and row offsets."""
    raw = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    size = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000), out=size[1:])
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(size[offsets].astype(np.int64)), pa.py_buffer(raw))
    return pc.if_else(nulls, pa.scalar(None, pa.large_string()), out) if nulls is not None else out


#: Bytes of text that the kernels take at once; temporaries are some twenty times as large.
SLICE_BYTES = 2 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array that hold at most ``most`` bytes each, or a single longer row."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield start, min(stop, len(texts))
        start = stop


def _touched(texts: pa.Array) -> np.ndarray:
    """Rows with a character outside printable ASCII and line feed."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2] or b"", np.uint8)
    raw = raw[ends[0] : ends[-1]]
    odd = np.flatnonzero((raw >= 0x80) | ((raw < 0x20) & (raw != 10)))
    seen = np.searchsorted(odd, ends - ends[0])
    return np.diff(seen) > 0


def _odd_rows(texts: pa.Array) -> np.ndarray:
    """Rows with a code point that may not be its own form; the others need no composing."""
    codes, offsets = to_codes(texts)
    seen = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(tables().odd[codes], out=seen[1:])
    return np.diff(seen[offsets]) > 0


def fold_array(texts: pa.Array) -> pa.Array:
    """The consistent form of an Arrow string array, as large_string."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    touched = pa.array(_touched(texts))
    some = texts.filter(touched)
    if not len(some):
        return texts
    odd = np.concatenate([_odd_rows(some.slice(a, b - a)) for a, b in slices(some)])
    mask = np.zeros(len(texts), bool)
    mask[np.flatnonzero(touched.to_numpy(zero_copy_only=False))[odd]] = True
    touched, some = pa.array(mask), some.filter(pa.array(odd))
    if not len(some):
        return texts
    parts = [from_codes(*fold_codes(*to_codes(some.slice(a, b - a)))) for a, b in slices(some)]
    return pc.replace_with_mask(texts, touched, pa.concat_arrays(parts))


def fold_column(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the consistent form of ``column`` as a further column ``into``, made batch by batch in Arrow."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != into), T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != into]
            folded = fold_array(batch.column(batch.schema.get_field_index(column)))
            small = folded.cast(pa.string()) if folded.nbytes < 2**31 else folded
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), small], [*kept, into])

    return df.mapInArrow(run, schema)


#: Rows of one form beyond which its pairs are made in parts of so many.
HOT_ROWS = 20_000


def look_pairs(df: DataFrame, key: str, text: str, within: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of keys whose texts look the same but are not the same string.

    ``df`` may deliver a row again; null texts and null keys take no part, an empty text looks only like one of
    invisible characters. ``within`` limits pairs to rows of equal value (null: no pair). Of the two texts of a
    pair at least one is not in the consistent form, so only those rows are joined with all rows; they meet under
    128 bits of hash of the consistent form. A form of more than ``hot_rows`` rows is split into parts by a hash of
    the key: each part is a join key of its own, which the odd rows of that form are given for all parts.

    Columns: key_a, key_b with key_a < key_b as strings.
    """
    scope = F.lit(0).cast("string") if within is None else within.cast("string")
    rows = df.select(scope.alias("_in"), F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    rows = fold_column(rows.filter("_in IS NOT NULL AND _key IS NOT NULL AND _text IS NOT NULL"), "_text", "_form")
    rows = checkpoint(
        rows.select(
            "_in",
            "_key",
            F.xxhash64("_form").alias("_f1"),
            F.xxhash64("_form", F.lit(7)).alias("_f2"),
            F.xxhash64("_text").alias("_raw"),
            (F.col("_form") != F.col("_text")).alias("_odd"),
        )
    )
    on = ["_in", "_f1", "_f2"]
    # only forms with an odd row matter; their number of parts goes to both sides
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_n"), F.bool_or("_odd").alias("_any")).filter("_any")
    parts = sizes.filter(F.col("_n") > hot_rows).select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    many = parts.count()
    odd = rows.filter("_odd").select(*on, F.col("_key").alias("_a"), F.col("_raw").alias("_ra")).distinct()
    other = rows.select(*on, F.col("_key").alias("_b"), F.col("_raw").alias("_rb"))
    if many:
        # at most one form to hot_rows rows; the narrow table is broadcast while it is short, else joined
        parts = F.broadcast(parts) if many <= 100_000 else parts
        odd = odd.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        other = other.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64("_b"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        pairs = odd.join(other, [*on, "_part"])
    else:
        pairs = odd.join(other, on)
    pairs = pairs.filter("_a <> _b AND _ra <> _rb")
    return pairs.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()
