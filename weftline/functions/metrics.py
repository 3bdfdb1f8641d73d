"""Surface metrics: additive counters per row and closed forms over their sums.

BLEU (13a tokens, exponential smoothing, effective order), chrF++ (6 character and 2 word orders, beta 2) and TER
(Snover et al. 2006, case-insensitive) are functions of counters that add up over segments, so any corpus score is a
SUM and a formula. The counters come from one Arrow pass; the formulas are column expressions.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters: system and reference length, then correct and total of the orders 1 to 4.
BLEU_SIZE = 10
#: Counters: hypothesis, reference and match counts of 6 character and 2 word orders.
CHRF_SIZE = 24
CHRF_CHARS, CHRF_WORDS, CHRF_BETA = 6, 2, 2.0
# Fixed values of the shift search: longest phrase, farthest move, candidates.
TER_PHRASE, TER_DISTANCE, TER_CANDIDATES = 10, 50, 1000

_13A = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def tokens_13a(text: str) -> list[str]:
    """Tokens of mteval-v13a."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    text = f" {text} "
    for pattern, to in _13A:
        text = pattern.sub(to, text)
    return text.split()


def _grams(items: list | str, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) if isinstance(items, list) else items[i : i + n] for i in range(len(items) - n + 1))


def bleu_counts(hyp: str, ref: str) -> list[int]:
    h, r = tokens_13a(hyp), tokens_13a(ref)
    correct, total = [], []
    for n in range(1, 5):
        own = _grams(h, n)
        correct.append(sum((own & _grams(r, n)).values()))
        total.append(max(0, len(h) - n + 1))
    return [len(h), len(r), *correct, *total]


def _chrf_words(text: str) -> list[str]:
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def chrf_counts(hyp: str, ref: str) -> list[int]:
    out = []
    sides = [(re.sub(r"\s+", "", hyp), re.sub(r"\s+", "", ref), CHRF_CHARS), (_chrf_words(hyp), _chrf_words(ref), CHRF_WORDS)]
    for h, r, orders in sides:
        for n in range(1, orders + 1):
            a, b = _grams(h, n), _grams(r, n)
            out += [sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values())]
    return out


def _distances(hyp: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Edit distances of all prefixes; a row per hypothesis word, made at once by a running minimum."""
    m = len(ref)
    steps = np.arange(m + 1)
    rows = np.empty((len(hyp) + 1, m + 1), np.int32)
    rows[0] = steps
    for i, word in enumerate(hyp, 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        np.minimum(rows[i - 1][:-1] + (ref != word), rows[i - 1][1:] + 1, out=row[1:])
        rows[i] = np.minimum.accumulate(row - steps) + steps
    return rows


def _last_distances(hyps: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Edit distances of many texts of one length, a column each, as ``_distances`` gives them one by one.

    Held less the place in the reference, so that the running minimum needs no further steps.
    """
    n, m = len(hyps), len(ref)
    held = np.zeros((m + 1, hyps.shape[1]), np.int32)
    row = np.empty_like(held)
    for i in range(n):
        row[0] = i + 1
        np.minimum(held[:-1] - (ref[:, None] == hyps[i]), held[1:] + 1, out=row[1:])
        np.minimum.accumulate(row, axis=0, out=held)
    return held[m] + m


def _trace(rows: np.ndarray, hyp: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors of hypothesis and reference words on a best path, and the hypothesis place of each reference word."""
    i, j = len(hyp), len(ref)
    bad_h, bad_r, place = np.zeros(i, bool), np.zeros(j, bool), np.zeros(j, np.int64)
    while i or j:
        if i and j and rows[i, j] == rows[i - 1, j - 1] + (hyp[i - 1] != ref[j - 1]):
            bad_h[i - 1] = bad_r[j - 1] = hyp[i - 1] != ref[j - 1]
            place[j - 1] = i - 1
            i, j = i - 1, j - 1
        elif i and rows[i, j] == rows[i - 1, j] + 1:
            bad_h[i - 1] = True
            i -= 1
        else:
            bad_r[j - 1] = True
            place[j - 1] = i - 1
            j -= 1
    return bad_h, bad_r, place


def _shifts(h: np.ndarray, r: np.ndarray, rows: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """The shifts that may help: (size, place, aim), and the text after it; phrases of ``h`` that stand in ``r`` elsewhere."""
    bad_h, bad_r, place = _trace(rows, h, r)
    for start in range(len(h)):
        for at in np.flatnonzero(r == h[start]):
            if abs(int(at) - start) > TER_DISTANCE or place[at] == start:
                continue
            target = int(place[at - 1]) + 1 if at else 0
            for size in range(1, TER_PHRASE + 1):
                if start + size > len(h) or at + size > len(r) or h[start + size - 1] != r[at + size - 1]:
                    break
                if bad_h[start : start + size].any() and bad_r[at : at + size].any() and not start <= target <= start + size:
                    piece, rest = h[start : start + size], np.concatenate([h[:start], h[start + size :]])
                    to = target - size if target > start else target
                    yield (size, -start, -to), np.concatenate([rest[:to], piece, rest[to:]])


def ter_counts(hyp: str, ref: str) -> list[int]:
    """Edits with shifts, and the reference length in words.

    At most ``TER_CANDIDATES`` shifts of a pair are tried, over all rounds, as the metric defines it.
    """
    h_words, r_words = hyp.lower().split(), ref.lower().split()
    if not r_words or not h_words:
        return [len(h_words) if not r_words else len(r_words), len(r_words)]
    number = {w: i for i, w in enumerate(dict.fromkeys(h_words + r_words))}
    h = np.array([number[w] for w in h_words])
    r = np.array([number[w] for w in r_words])
    shifts, left = 0, TER_CANDIDATES
    rows = _distances(h, r)
    while rows[-1, -1] > 0 and left > 0:
        found = list(islice(_shifts(h, r, rows), left))
        left -= len(found)
        if not found:
            break
        ends = np.concatenate([_last_distances(np.array([m for _, m in found[k : k + 256]]).T.copy(), r) for k in range(0, len(found), 256)])
        gain, *_, best = max((int(rows[-1, -1] - end), *key, -k) for k, (end, (key, _)) in enumerate(zip(ends, found, strict=True)))
        if gain <= 0:
            break
        h = found[-best][1]
        rows = _distances(h, r)
        shifts += 1
    return [int(rows[-1, -1]) + shifts, len(r)]


def _counted(count, size: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hyps, refs in batches:
            memo: dict[tuple, list[int]] = {}
            out = []
            for pair in zip(hyps, refs, strict=True):
                if pair[0] is None or pair[1] is None:
                    out.append(None)
                    continue
                if pair not in memo:
                    memo[pair] = count(*pair)
                out.append(memo[pair])
            yield pd.Series(out, dtype=object)

    run.__name__ = f"{count.__name__}_{size}"
    return F.pandas_udf(run, "array<bigint>")


def bleu_stats(hyp: Column | str, ref: Column | str) -> Column:
    """The ten BLEU counters of a pair; null if a text is null."""
    return _counted(bleu_counts, BLEU_SIZE)(hyp, ref)


def chrf_stats(hyp: Column | str, ref: Column | str) -> Column:
    """The 24 chrF++ counters of a pair; null if a text is null."""
    return _counted(chrf_counts, CHRF_SIZE)(hyp, ref)


def ter_stats(hyp: Column | str, ref: Column | str) -> Column:
    """Edits and reference length of a pair; null if a text is null."""
    return _counted(ter_counts, 2)(hyp, ref)


def sum_stats(stats: Column | str, size: int) -> Column:
    """Aggregate: the counters added up over rows."""
    column = F.col(stats) if isinstance(stats, str) else stats
    return F.array(*(F.sum(column[i]) for i in range(size)))


def bleu(stats: Column) -> Column:
    """BLEU of counters, of one row or summed."""
    sys_len, ref_len = stats[0].cast("double"), stats[1].cast("double")
    correct, total = [stats[2 + i].cast("double") for i in range(4)], [stats[6 + i].cast("double") for i in range(4)]
    logs, order, smooth = F.lit(0.0), F.lit(0), F.lit(1.0)
    for c, t in zip(correct, total, strict=True):
        smooth = F.when((t > 0) & (c == 0), smooth * 2).otherwise(smooth)
        share = F.when(c > 0, 100 * c / t).otherwise(100 / (smooth * t))
        logs = logs + F.when(t > 0, F.log(share)).otherwise(0.0)
        order = order + F.when(t > 0, 1).otherwise(0)
    penalty = F.when(sys_len < ref_len, F.exp(1 - ref_len / sys_len)).otherwise(1.0)
    score = penalty * F.exp(logs / order)
    none = correct[0] + correct[1] + correct[2] + correct[3] == 0
    return F.when(stats.isNull() | stats[0].isNull(), F.lit(None).cast("double")).when(none, 0.0).otherwise(score)


def chrf(stats: Column) -> Column:
    """chrF++ of counters, of one row or summed."""
    at = lambda i, k: F.element_at(stats, (3 * i + (k + 1)).cast("int")).cast("double")
    shares = lambda i: F.struct((at(i, 2) / at(i, 0)).alias("p"), (at(i, 2) / at(i, 1)).alias("r"))
    orders = F.filter(F.sequence(F.lit(0), F.lit(CHRF_CHARS + CHRF_WORDS - 1)), lambda i: (at(i, 0) > 0) & (at(i, 1) > 0))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("r"))
    add = lambda s, x: F.struct((s["p"] + x["p"]).alias("p"), (s["r"] + x["r"]).alias("r"))
    factor = CHRF_BETA**2

    def form(s: Column) -> Column:
        p, q = s["p"] / F.size(orders), s["r"] / F.size(orders)
        return F.when(s["p"] + s["r"] == 0, 0.0).otherwise(100 * (1 + factor) * p * q / (factor * p + q))

    score = F.aggregate(F.transform(orders, shares), start, add, form)
    return F.when(stats.isNull() | stats[0].isNull(), F.lit(None).cast("double")).otherwise(score)


def ter(stats: Column) -> Column:
    """TER of counters, of one row or summed; without reference words 100 if there are edits, else 0."""
    edits, length = stats[0].cast("double"), stats[1].cast("double")
    return F.when(length > 0, 100 * edits / length).when(edits > 0, 100.0).when(edits == 0, 0.0)


SIGNATURES = {
    "bleu": "weftline|ngram:4|smooth:exp|eff:yes|tok:13a|case:mixed",
    "chrf": "weftline|char:6|word:2|beta:2|space:no|eff:yes|case:mixed",
    "ter": "weftline|norm:no|punct:yes|asian:no|case:lc",
}

COUNTERS = {"bleu": (BLEU_SIZE, bleu_stats, bleu), "chrf": (CHRF_SIZE, chrf_stats, chrf), "ter": (2, ter_stats, ter)}


def corpus_metric(rows: DataFrame, name: str, hyp: str = "hyp_text", ref: str = "ref_text") -> float:
    """One corpus score by name. A null text, no row or an unknown name is an error."""
    if name not in COUNTERS:
        raise ValueError(f"unknown metric {name}; known: {', '.join(COUNTERS)}")
    size, counts, form = COUNTERS[name]
    both = rows.select(F.col(hyp).alias("h"), F.col(ref).alias("r")).withColumn("s", counts("h", "r"))
    got = both.agg(F.count("*").alias("n"), F.count("s").alias("whole"), sum_stats("s", size).alias("s")).select("n", "whole", form(F.col("s")).alias("score")).first()
    if not got["n"] or got["n"] != got["whole"]:
        raise ValueError("a metric needs rows, with a text and a reference in each")
    return got["score"]
