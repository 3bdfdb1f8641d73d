"""Problem 10: long exact spans shared between records.

Paragraph MinHash banding, with the paragraph taken as every window of ``span`` code points. The sketch of a
paragraph is the least hash of its shingles of ``shingle`` code points: one band of one row. Two equal windows
hold the same shingles and so always collide, which makes the recall of shared verbatim spans 1 by construction;
windows that only resemble each other collide only if they share a whole shingle. As neighbouring windows mostly
have the same least shingle, a document keeps few distinct sketches (about 2 in span - shingle + 2 characters).
Colliding documents are then verified on their texts, exactly.

Exact copies are grouped before: one representative per distinct text goes through banding and verification, and
copies come back through the membership.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.charfold import slices, to_codes
from weftline.llm.components import components
from weftline.session import checkpoint

SPAN = 400
SHINGLE = 300
#: Texts with one sketch beyond which their pairs are made in parts of so many.
PART = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` code points; equal windows have equal hashes anywhere."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    unpowers = np.full(n - width + 1, _UNBASE, np.uint64)
    unpowers[0] = 1
    return _mix((sums[width:] - sums[:-width]) * np.cumprod(unpowers))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` values, by block prefix and suffix minima."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sketches(codes: np.ndarray, offsets: np.ndarray, span: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and sketch of each distinct paragraph sketch of each row."""
    hashes = window_hashes(codes, shingle)
    least = sliding_min(hashes, span - shingle + 1)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    inside = np.arange(len(least)) + span <= offsets[row + 1]
    row, least = row[inside], least[inside]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    both = np.unique(np.stack([row[fresh], least[fresh].view(np.int64)]), axis=1)
    return both[0], both[1]


def shared_spans(a: str, b: str, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """Maximal verbatim spans of at least ``span`` code points: (start in a, end in a, start in b, end in b).

    Of the places of a repeated window in ``b`` one is reported for each place in ``a`` and the other way round, so
    that the union of spans covers what is shared in each of the two texts.
    """
    one = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    two = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4")
    h1, h2 = window_hashes(one, span), window_hashes(two, span)
    if not len(h1) or not len(h2):
        return []
    out: set[tuple[int, int, int, int]] = set()
    for left, right, turned in ((h1, h2, False), (h2, h1, True)):
        order = np.argsort(right, kind="stable")
        at = np.minimum(np.searchsorted(right[order], left), len(right) - 1)
        hit = np.flatnonzero(right[order][at] == left)
        if not len(hit):
            continue
        other = order[at[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(other) != 1)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(hit)) - 1
        for f, l in zip(firsts, lasts, strict=True):
            s, o, n = int(hit[f]), int(other[f]), int(hit[l] - hit[f]) + span
            x, y = (b[s : s + n], a[o : o + n]) if turned else (a[s : s + n], b[o : o + n])
            if x == y:  # not only equal hashes
                out.add((o, o + n, s, s + n) if turned else (s, s + n, o, o + n))
    return sorted(out)


def copy_classes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Key, rep (least key of the equal texts) and size of each text of at least ``least`` code points.

    Counted by 128 bits of hash and the length; the least key is pre-aggregated before the shuffle, and the class
    of each key is found by a join of narrow rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(1)).alias("_h2"), F.length(text).alias("n_chars"))
    rows = rows.filter((F.col("n_chars") >= least) & F.col("key").isNotNull())
    reps = rows.groupBy("_h1", "_h2", "n_chars").agg(F.min("key").alias("rep"))
    return rows.join(reps, ["_h1", "_h2", "n_chars"]).select("key", "rep", "n_chars").distinct()


class SharedSpans:
    """Finds all pairs of records that share a verbatim span of at least ``span`` code points.

    Null keys and null or shorter texts take no part. Repeated keys count once if their texts are equal. Memory of
    a task is bounded by an Arrow batch and by single texts.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, shingle: int = SHINGLE):
        if not 0 < shingle <= span:
            raise ValueError("a shingle is at most as long as the span")
        self.docs, self.key, self.text, self.span, self.shingle = docs, key, text, span, shingle
        self.classes = checkpoint(copy_classes(docs, key, text, span))
        only = self.classes.filter("key = rep").select(F.col("rep").alias("_rep"))
        self.texts = docs.select(F.col(key).alias("_rep"), F.col(text).alias("_text")).join(only, "_rep").dropDuplicates(["_rep"])

    def candidates(self) -> DataFrame:
        """Pairs of representatives with a common paragraph sketch."""
        span, shingle = self.span, self.shingle
        kind = self.texts.schema["_rep"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop in slices(batch.column(1)):
                    part = batch.slice(start, stop - start)
                    rows, values = sketches(*to_codes(part.column(1)), span, shingle)
                    yield pa.RecordBatch.from_arrays([pa.array(values), part.column(0).take(pa.array(rows))], ["sketch", "rep"])

        marks = checkpoint(self.texts.mapInArrow(run, f"sketch long, rep {kind}"))
        # a passage in more texts than PART makes parts of its own, so that no task makes all of its pairs
        sizes = marks.groupBy("sketch").agg(F.count("*").alias("_n")).filter("_n > 1")
        shared = marks.join(sizes, "sketch").withColumn("_parts", F.ceil(F.col("_n") / PART).cast("int"))
        left = shared.select("sketch", F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        right = shared.select("sketch", F.col("rep").alias("b"), F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int").alias("_part"))
        return left.join(right, ["sketch", "_part"]).filter("a < b").select("a", "b").distinct()

    def spans(self) -> DataFrame:
        """Columns a, b, a_start, a_end, b_start, b_end: verified spans of pairs of representatives."""
        if not hasattr(self, "_spans"):
            span = self.span
            kind = self.texts.schema["_rep"].dataType.simpleString()
            pairs = checkpoint(self.candidates())
            texts = self.texts.select(F.col("_rep").alias("a"), F.col("_text").alias("ta"))
            other = self.texts.select(F.col("_rep").alias("b"), F.col("_text").alias("tb"))
            pairs = pairs.join(texts, "a").join(other, "b").select("a", "b", "ta", "tb")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names = ["a", "b", "a_start", "a_end", "b_start", "b_end"]
                for batch in batches:
                    rows, spots = [], []
                    for i in range(batch.num_rows):
                        for spot in shared_spans(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), span):
                            rows.append(i)
                            spots.append(spot)
                    at = pa.array(rows, pa.int64())
                    places = [pa.array([s[k] for s in spots], pa.int32()) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *places], names)

            found = pairs.mapInArrow(run, f"a {kind}, b {kind}, a_start int, a_end int, b_start int, b_end int")
            self._spans = checkpoint(found)
        return self._spans

    def links(self) -> DataFrame:
        """Pairs a < b of representatives of different texts that share a span."""
        return self.spans().select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """All pairs doc_a < doc_b of records, copies written out."""
        of = self.classes.select("key", "rep")
        left = of.select(F.col("key").alias("x"), F.col("rep").alias("a"))
        right = of.select(F.col("key").alias("y"), F.col("rep").alias("b"))
        across = self.links().join(left, "a").join(right, "b").select("x", "y")
        within = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
        both = across.unionByName(within)
        return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def report(self) -> DataFrame:
        """One row per record of at least ``span`` code points.

        Columns: key, rep, n_chars, copies (records of equal text, itself included), n_links (other texts that share
        a span), shared_chars (characters inside spans that occur elsewhere), shared_part, class_id (least rep of
        its connected component) and keep (whether it is the record kept of its component).
        """
        from pyspark.sql import Window

        spans = self.spans()
        sides = spans.selectExpr("a AS rep", "b AS other", "a_start AS s", "a_end AS e").unionByName(spans.selectExpr("b AS rep", "a AS other", "b_start AS s", "b_end AS e"))
        links = sides.groupBy("rep").agg(F.count_distinct("other").alias("n_links"))
        ordered = Window.partitionBy("rep").orderBy("s", "e")
        ends = sides.select("rep", "s", "e").distinct().withColumn("_seen", F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        gain = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("_seen", F.lit(0))))
        covered = ends.groupBy("rep").agg(F.sum(gain).alias("_covered"))
        sizes = self.classes.groupBy("rep").agg(F.count("*").alias("copies"))
        labels = components(self.links(), "a", "b").select(F.col("node").alias("rep"), F.col("label"))
        facts = sizes.join(links, "rep", "left").join(covered, "rep", "left").join(labels, "rep", "left")
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("_covered", F.lit(0))).cast("long")
        return self.classes.join(facts, "rep").select(
            "key",
            "rep",
            "n_chars",
            "copies",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            shared.alias("shared_chars"),
            (shared / F.col("n_chars")).alias("shared_part"),
            F.coalesce("label", "rep").alias("class_id"),
            (F.col("key") == F.coalesce("label", "rep")).alias("keep"),
        )
