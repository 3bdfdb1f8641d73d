"""Problem 4: token counts under a public tokenizer, without making the tokens.

A double-array trie holds the vocabulary. Counting walks the lattice of vocabulary matches once, keeping for each
place only the best path's score and length (count-only Viterbi).

For a unigram vocabulary the score is the sum of log probabilities. The public vocabularies at hand are merge
tables, whose tokens are not the best unigram path; for them the same walk keeps, for each place, the one last token
that a merge encoding of the text up to there can have: a path is the merge encoding if and only if each pair of
neighbouring tokens encodes to itself. Each place has exactly one such token, so the walk again needs one count per
place, and its result is exact.

Text is cut by the tokenizer's own pattern before merges; counts of pieces are kept in a bounded cache per worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.charfold import fold_column
from weftline.schema import domain, language

#: Folder of the public vocabularies; never copied into the repository.
TOKENIZERS = "/opt/tokenizers"
#: The multilingual byte-level vocabulary, as the texts are German, English and Turkish.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that these vocabularies' pieces were cut by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 1 << 17


class DoubleArrayTrie:
    """Byte trie in two arrays: state s goes by byte b to base[s] + b + 1 if check there is s. Value -1: no key."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = max(1024, 4 * sum(map(len, keys)) // 3)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = 1
        stack = [(0, 0, len(order), 0)]
        while stack:
            state, low, high, depth = stack.pop()
            if low < high and len(keys[order[low]]) == depth:
                value[state] = order[low]
                while low < high and len(keys[order[low]]) == depth:
                    low += 1
            if low == high:
                continue
            groups: list[tuple[int, int, int]] = []
            at = low
            while at < high:
                byte, begin = keys[order[at]][depth], at
                while at < high and keys[order[at]][depth] == byte:
                    at += 1
                groups.append((byte, begin, at))
            first = groups[0][0]
            place = max(free, first + 1)
            while True:
                while place < len(check) and check[place] != -1:
                    place += 1
                start = place - first - 1
                need = start + groups[-1][0] + 2
                if need > len(check):
                    more = max(need - len(check), len(check) // 2)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[start + b + 1] == -1 for b, _, _ in groups):
                    break
                place += 1
            if len(groups) > 32:
                free = place
            while free < len(check) and check[free] != -1:
                free += 1
            base[state] = start
            for byte, begin, end in groups:
                check[start + byte + 1] = state
                stack.append((start + byte + 1, begin, end, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """The arrays as lists, which single steps read faster."""
        return self.base.tolist(), self.check.tolist(), self.value.tolist()


class UnigramCounter:
    """Length of the best unigram path of a text; a character outside the vocabulary is one unknown token.

    ``pieces``: text and log probability. With ``space`` set, blanks become that character, one is put before the
    text, and words are counted apart where no piece holds the character after its beginning.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: float | None = None, space: str | None = "▁"):
        self.trie = DoubleArrayTrie([p.encode() for p, _ in pieces])
        self.scores = [s for _, s in pieces]
        self.unknown = min(self.scores, default=0.0) - 10.0 if unknown is None else unknown
        self.space = space
        self.apart = space is not None and not any(space in p[1:] for p, _ in pieces)
        self._lists = self.trie.lists()
        self.count_piece = lru_cache(maxsize=_CACHE)(self._count)

    def _count(self, text: str) -> int:
        base, check, value = self._lists
        raw = text.encode("utf-8", "replace")
        n = len(raw)
        best = [float("-inf")] * (n + 1)
        length = [0] * (n + 1)
        best[0] = 0.0
        limit = len(check)
        for i in range(n):
            score = best[i]
            if score == float("-inf") or raw[i] & 0xC0 == 0x80:
                continue
            width = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            state, known = 0, False
            for j in range(i, n):
                to = base[state] + raw[j] + 1
                if to >= limit or check[to] != state:
                    break
                state = to
                token = value[state]
                if token >= 0:
                    known = known or j + 1 == i + width
                    total = score + self.scores[token]
                    if total > best[j + 1]:
                        best[j + 1], length[j + 1] = total, length[i] + 1
            if not known and score + self.unknown > best[i + width]:
                best[i + width], length[i + width] = score + self.unknown, length[i] + 1
        return length[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.space is None:
            return self._count(text)
        text = self.space + text.replace(" ", self.space)
        if not self.apart:
            return self._count(text)
        return sum(self.count_piece(self.space + word) for word in text.split(self.space)[1:])


class MergeCounter:
    """Number of tokens of a byte-level merge vocabulary, given as token bytes by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ranks = ranks
        self.trie = DoubleArrayTrie(self.tokens)
        self._lists = self.trie.lists()
        self.find = regex.compile(pattern).findall
        self.count_piece = lru_cache(maxsize=_CACHE)(self._count)
        self.fits = lru_cache(maxsize=_CACHE)(self._fits)

    def _fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens encode to just these two."""
        parts = [bytes([b]) for b in self.tokens[left] + self.tokens[right]]
        while len(parts) > 1:
            least, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [self.tokens[left], self.tokens[right]]

    def _count(self, piece: str) -> int:
        raw = piece.encode("utf-8", "replace")
        if raw in self.ranks and self.whole(self.ranks[raw]):
            return 1
        base, check, value = self._lists
        limit, n = len(check), len(raw)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            state = 0
            for j in range(i, n):
                to = base[state] + raw[j] + 1
                if to >= limit or check[to] != state:
                    break
                state = to
                token = value[state]
                if token >= 0 and last[j + 1] < 0 and (self.fits(last[i], token) if i else self.whole(token)):
                    last[j + 1], length[j + 1] = token, length[i] + 1
        return length[n]

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token encode to it alone."""
        known = self.__dict__.setdefault("_whole", {})
        if token not in known:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 1:
                least, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                if least == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known[token] = parts == [self.tokens[token]]
        return known[token]

    def count(self, text: str) -> int:
        return sum(map(self.count_piece, self.find(text))) if text else 0


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def counter(vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> MergeCounter:
    """The counter of a named public vocabulary, built once per worker."""
    return MergeCounter(read_ranks(os.path.join(folder, vocabulary)))


def with_counts(df: DataFrame, text: str, into: str = "n_tokens", make: Callable | None = None, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` without ``text`` and with its number of tokens as ``into``; null and empty texts have none."""
    fields = [f for f in df.schema.fields if f.name not in (text, into)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{into}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (make() if make else counter(vocabulary, folder)).count
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counts = pa.array([count(t) if t else 0 for t in column.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), counts], [*(f.name for f in fields), into])

    return df.mapInArrow(run, schema)


def segment_tokens(segments: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """One row per distinct segment: id, source, lang, domain, n_tokens, n_chars of its source text in consistent form.

    A segment delivered again counts once, with the first filled value of each column by time of loading, and is
    tokenized once: deliveries are brought together before, pre-aggregated. A null ``id`` is no segment. Null or empty
    texts have no token, a null or empty domain is 'unspecified', an unknown language spelling 'unknown'.
    """
    lang, own = F.coalesce(language("src_lang"), F.lit("unknown")), F.nullif(domain("domain"), F.lit("unspecified"))
    rows = segments.filter("id IS NOT NULL").select("id", "source", lang.alias("lang"), own.alias("domain"), F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp")).alias("loaded_at"), "src_text")
    order = F.struct("loaded_at", F.coalesce("src_text", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("domain", F.lit("")), "lang")
    filled = F.col("domain").isNotNull()
    once = rows.groupBy("id").agg(
        F.min_by("source", order).alias("source"),
        F.min_by("lang", order).alias("lang"),
        F.coalesce(F.min_by("domain", F.when(filled, order)), F.lit("unspecified")).alias("domain"),
        F.min_by("src_text", order).alias("src_text"),
    )
    folded = fold_column(once, "src_text", "_form").drop("src_text").withColumn("n_chars", F.coalesce(F.length("_form"), F.lit(0)))
    return with_counts(folded, "_form", "n_tokens", vocabulary=vocabulary, folder=folder).select("id", "source", "lang", "domain", "n_tokens", "n_chars")


def budget(per_segment: DataFrame) -> DataFrame:
    """Totals by source, lang and domain: segments, tokens, chars."""
    return per_segment.groupBy("source", "lang", "domain").agg(F.count("*").alias("segments"), F.sum("n_tokens").alias("tokens"), F.sum("n_chars").alias("chars"))
