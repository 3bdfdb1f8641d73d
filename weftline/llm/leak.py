"""Problem 9: evaluation texts leaking into training text.

Each Arrow batch of the corpus is one shard. Both sides are brought to the consistent form, lower-cased and cut
into words; words that no test item holds can't be part of a match and become breaks. Over what remains of the
shard a suffix array is built by prefix doubling on word numbers. All suffixes of all test items are then searched
in lockstep by binary search, which gives the run of corpus suffixes that agree in ``least`` words; each is
extended to its longest verbatim match.

The test side is the stated query set: it is held by every task only while it is below ``block_bytes``; larger
sets go through the corpus in blocks of that size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.charfold import fold_array

#: Consecutive words that make a passage.
LEAST_WORDS = 10
#: Bytes of test text that a task holds at once.
BLOCK_BYTES = 16 << 20

_WORD = re.compile(r"[^\W_]+")


def words_of(texts: pa.Array) -> list[list[str]]:
    """The words of each text in the consistent form, lower-cased; none for null."""
    return [_WORD.findall(t.lower()) if t else [] for t in fold_array(texts).to_pylist()]


def suffix_array(values: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over at least ``depth`` values. Values are above 0."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64) + 1
    width, order = 1, np.argsort(rank, kind="stable")
    while width < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if rank[order[-1]] == n:
            break
    return order


class TestIndex:
    """Word numbers of the test items and the suffixes that can begin a passage."""

    __test__ = False  # not a test class

    def __init__(self, ids: list[int], texts: list[str | None], least: int = LEAST_WORDS):
        self.least = least
        lists = words_of(pa.array(texts, pa.string()))
        self.number = {w: i + 2 for i, w in enumerate(sorted({w for words in lists for w in words}))}
        flat: list[int] = []
        starts, owners = [], []
        for item, words in zip(ids, lists, strict=True):
            for k in range(len(words) - least + 1):
                starts.append(len(flat) + k)
                owners.append(item)
            flat.extend(self.number[w] for w in words)
            flat.append(0)  # no word: ends every comparison
        self.values = np.array(flat + [0] * least, np.int64)
        self.starts = np.array(starts, np.int64)
        self.owners = np.array(owners, np.int64)
        self.longest = max((len(w) for w in lists), default=0)

    def search(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners, positions in the shard and lengths in words of all matches of at least ``least`` words.

        ``shard`` holds word numbers; 1 is a break.
        """
        none = np.zeros(0, np.int64)
        least = self.least
        open_ = shard > 1
        ends = np.append(np.flatnonzero(~open_), len(shard))
        room = ends[np.searchsorted(ends, np.arange(len(shard)))] - np.arange(len(shard))
        usable = room >= least
        if not usable.any() or not len(self.starts):
            return none, none, none
        inside = np.zeros(len(shard) + 1, np.int64)  # positions that lie in a run long enough
        at = np.flatnonzero(usable)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + least, -1)
        held = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        gap = np.zeros(len(held), np.int64)
        gap[1:] = np.diff(held) != 1
        place = np.arange(len(held)) + np.cumsum(gap)
        values = np.ones(len(held) + int(gap.sum()) + self.longest + least + 1, np.int64)
        origin = np.full(len(values), -1, np.int64)
        values[place], origin[place] = shard[held], held
        order = suffix_array(values, max(least, self.longest))
        words = np.arange(least)
        wanted = self.values[self.starts[:, None] + words]

        def bound(right: bool) -> np.ndarray:
            lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
            while (live := lo < hi).any():
                mid = (lo + hi) // 2
                spots = order[np.minimum(mid, len(order) - 1)][:, None] + words
                have = np.where(spots < len(values), values[np.minimum(spots, len(values) - 1)], 0)
                differ = have != wanted
                first = differ.argmax(1)
                rows = np.arange(len(wanted))
                less = differ.any(1) & (have[rows, first] < wanted[rows, first])
                same = ~differ.any(1)
                go = less | (same if right else False)
                lo, hi = np.where(live & go, mid + 1, lo), np.where(live & ~go, mid, hi)
            return lo

        low, high = bound(False), bound(True)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        if not len(which):
            return none, none, none
        spots = order[np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        length = np.full(len(which), least, np.int64)
        growing = np.arange(len(which))
        while len(growing):
            same = values[spots[growing] + length[growing]] == self.values[self.starts[which[growing]] + length[growing]]
            growing = growing[same]
            length[growing] += 1
        return self.owners[which], origin[spots], length


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int, least: int) -> Iterator[TestIndex]:
    narrow = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").distinct()
    total = narrow.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = int(-(-total // block_bytes)) or 1
    for block in range(count):
        rows = narrow.filter(F.pmod(F.xxhash64("k"), F.lit(count)) == block).collect()
        yield TestIndex([r.k for r in rows], [r.t for r in rows], least)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns doc_id, item_id, n_words (longest verbatim match), first_word (its place in the document, from 0).

    One row per document and item that share at least ``least`` consecutive words. Null keys or texts and texts
    with fewer words take no part; repeated rows count once; an empty test set or corpus gives no row.
    """
    schema = "doc_id long, item_id long, n_words int, first_word int"
    narrow = docs.select(F.col(doc_key).cast("long").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL")
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(items, item_key, text, block_bytes, least):

        def run(batches: Iterator[pa.RecordBatch], index: TestIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                lists = words_of(batch.column(1))
                shard: list[int] = []
                begin = np.zeros(len(lists) + 1, np.int64)
                get = index.number.get
                for i, words in enumerate(lists):
                    shard.extend([get(w, 1) for w in words])
                    shard.append(1)
                    begin[i + 1] = len(shard)
                owner, place, length = index.search(np.array(shard, np.int64))
                row = np.searchsorted(begin, place, side="right") - 1
                order = np.lexsort((place, -length, owner, row))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(owner[order]) != 0)
                best = order[fresh]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row[best]], pa.int64()), pa.array(owner[best]), pa.array(length[best], pa.int32()), pa.array(place[best] - begin[row[best]], pa.int32())],
                    ["doc_id", "item_id", "n_words", "first_word"],
                )

        found = found.unionByName(narrow.mapInArrow(run, schema))
    best = F.max_by(F.struct("n_words", "first_word"), F.struct("n_words", -F.col("first_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", "_b.n_words", "_b.first_word")


def without_leaks(docs: DataFrame, found: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents without a row in ``found``, all columns; documents with a null key stay."""
    gone = found.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_key] == F.col("_gone"), "left_anti")
