"""Problem 6: sentence alignment in bilingual documents.

Two rounds learn word tables per source language and align by them. The tables hold, for each word, the words of the
other language that lines paired with its lines hold far more often than others (confidence of either direction above
the word's base rate). The first round learns from lines that carry the
same unique numbers, and from lines in the same place of documents with as many lines on both sides; the second one
learns from the pairs of the first.

Word pairs are counted from distinct pairs of lines, numbers left out. In lines of more than ``LONG`` words a word pairs
with the words around the same relative place, so that a line without a break takes time in proportion to its length.

The tables go to all tasks while they hold at most ``most_entries`` rows. Larger ones stay in Spark: each document then
gets the rows of its own words by a join, with the same result.

Within a document each line becomes a weighted bag of target words, and the other way round. Inverted indexes of the
lines' words retrieve candidates in both directions; pairs that are each other's best are taken, again and again
among what is left. Then merges grow: a line that is still alone joins a neighbour's partner, or else any line, if
what that line holds beyond its own partner explains it.

Numbers compare by their significant digits, so that a change of unit does not part them; dates by their day.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.charfold import fold_array
from weftline.operators.quantities import NUMBER_WORDS
from weftline.schema import language
from weftline.session import checkpoint

#: Rows of the learned tables up to which all tasks hold them; beyond, each document is joined with its own rows.
MOST_ENTRIES = 200_000
#: Words of a line beyond which words pair by place only, with so many around.
LONG = 64
#: The least confidence above the base rate.
LEAST_CONFIDENCE = 0.15
#: Part of the best confidence of either word that a pair needs, which parts translations from company.
LEAST_OF_BEST = 0.5
#: Confidence is raised by this, up to one, as two or three wordings share a sense.
SHARPEN = 1.6
#: Mean explained share of two lines that pair, and of a line that joins another pair.
LEAST_PAIR = 0.45
LEAST_MERGE = 0.65
#: Share of the other line that a merged line explains beyond the first partner.
LEAST_REST = 0.5

_TOKEN = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4}|[.,]?\d+(?:[.,]\d+)*|[^\W\d_]+:?")
_SMALL_WORDS = {w: f"#{n}" for n, words in NUMBER_WORDS.items() if 1 < n <= 12 for w in words.split() if w != "on"}


def tokens(line: str) -> list[str]:
    """Distinct tokens of a line: words, '#' and significant digits, '@' and the day of a date."""
    out = {}
    for t in _TOKEN.findall(line.lower()):
        if t[0].isdigit() or t[0] in ".,":
            if len(t) == 10 and t[4] == "-" and t[7] == "-":
                t = "@" + t
            elif t.count(".") == 2 and "," not in t and len(t) >= 8 and len(t.rsplit(".", 1)[1]) == 4:
                d, m, y = t.split(".")
                t = f"@{y}-{m:0>2}-{d:0>2}"
            else:
                t = "#" + (re.sub(r"\D", "", t).strip("0") or "0")
        elif t in _SMALL_WORDS:
            t = _SMALL_WORDS[t]
        out[t] = None
    return list(out)


def _is_number(token: str) -> bool:
    return token[0] in "#@"


def first_pairs(src: list[list[str]], ref: list[list[str]]) -> list[tuple[int, int]]:
    """Line pairs to learn from without tables: unique equal numbers, else equal places of equally long texts."""
    out = set()
    signs = []
    for lines in (src, ref):
        places = defaultdict(list)
        for i, line in enumerate(lines):
            numbers = tuple(sorted(t for t in line if _is_number(t) and len(t) > 2))
            if numbers:
                places[numbers].append(i)
        signs.append({k: v[0] for k, v in places.items() if len(v) == 1})
    for numbers, i in signs[0].items():
        if numbers in signs[1]:
            out.add((i, signs[1][numbers]))
    if len(src) == len(ref):
        held, taken = {i for i, _ in out}, {j for _, j in out}
        out |= {(i, i) for i in range(len(src)) if i not in held and i not in taken}
    return sorted(out)


class Tables:
    """Word tables of both directions and the weights of words."""

    def __init__(self, rows: list[tuple[str, str, float]], weights: dict[str, float], common: float):
        self.forth: dict[str, list[tuple[str, float]]] = defaultdict(list)
        self.back: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for s, t, p in rows:
            self.forth[s].append((t, p))
            self.back[t].append((s, p))
        self.weights, self.common = weights, common

    def weight(self, token: str) -> float:
        if _is_number(token):
            return 7.0 if token[0] == "@" else min(7.0, 2.0 + 1.5 * len(token[1:]))
        return self.weights.get(token, self.common)


def _bags(lines: list[list[str]], index: dict[str, list[int]], table: dict, weights: dict[str, float]) -> tuple[list[dict[str, float]], list[dict[int, float]]]:
    """For each line the words of the other side that it explains, with how far, and by line there their weight."""
    at_hand: dict[str, list[tuple[str, float]]] = {}
    bags, sums = [], []
    for line in lines:
        bag: dict[str, float] = {}
        for word in line:
            known = at_hand.get(word)
            if known is None:
                known = [(t, p) for t, p in (() if word[0] in "#@" else table.get(word, ())) if t in index]
                if word in index:
                    known.append((word, 1.0))
                at_hand[word] = known
            for token, p in known:
                if p > bag.get(token, 0.0):
                    bag[token] = p
        found: dict[int, float] = {}
        for token, p in bag.items():
            value = weights[token] * p
            for j in index[token]:
                found[j] = found.get(j, 0.0) + value
        bags.append(bag)
        sums.append(found)
    return bags, sums


def align(src: list[list[str]], ref: list[list[str]], tables: Tables) -> list[tuple[int, int]]:
    """Pairs of lines (from 0) that wholly or partly translate one another."""
    weights = {t: tables.weight(t) for lines in (src, ref) for line in lines for t in line}
    weigh = weights.__getitem__
    mass = [[sum(map(weigh, line)) or 1e-9 for line in lines] for lines in (src, ref)]
    indexes: list[dict[str, list[int]]] = []
    for lines in (src, ref):
        index: dict[str, list[int]] = {}
        for i, line in enumerate(lines):
            for token in line:
                index.setdefault(token, []).append(i)
        indexes.append(index)
    # explained words of target lines by source line, and of source lines by target line
    bags_s, forth = _bags(src, indexes[1], tables.forth, weights)
    bags_r, back = _bags(ref, indexes[0], tables.back, weights)
    score: dict[tuple[int, int], tuple[float, float, float]] = {}
    for i, found in enumerate(forth):
        for j, value in found.items():
            other = back[j].get(i)
            if other is not None:
                of_ref, of_src = value / mass[1][j], other / mass[0][i]
                near = 0.02 * (1 - abs(i / max(1, len(src) - 1) - j / max(1, len(ref) - 1)))
                score[i, j] = (of_src + of_ref) / 2 + near, of_src, of_ref
    pairs: list[tuple[int, int]] = []
    free_s, free_r = set(range(len(src))), set(range(len(ref)))
    # each other's best, again among what is left, is the best pair of all first; a joined line is found by its share
    fit = [x for x in score.items() if x[1][0] >= LEAST_PAIR or max(x[1][1:]) >= LEAST_MERGE + 0.1 and min(x[1][1:]) >= 0.2]
    for (i, j), _ in sorted(fit, key=lambda x: -x[1][0]):
        if i in free_s and j in free_r:
            pairs.append((i, j))
            free_s.discard(i)
            free_r.discard(j)
    partner_s: dict[int, list[int]] = defaultdict(list)
    partner_r: dict[int, list[int]] = defaultdict(list)
    for i, j in pairs:
        partner_s[i].append(j)
        partner_r[j].append(i)

    def grows(alone: int, other: int, own: float, turned: bool) -> float:
        """How well a lone line is explained by what the other line holds beyond its partners; 0 if too little."""
        # the lone line must also explain words of the other line that its partners leave open
        bags, line, partners = (bags_r, src[other], partner_s[other]) if turned else (bags_s, ref[other], partner_r[other])
        bag = bags[alone]
        found = {t: bag[t] for t in line if t in bag}
        held: dict[str, float] = {}
        for p in partners:
            for token in found:
                held[token] = max(held.get(token, 0.0), bags[p].get(token, 0.0))
        gained = sum(weigh(t) * max(0.0, x - held.get(t, 0.0)) for t, x in found.items())
        total = sum(weigh(t) * x for t, x in found.items()) or 1e-9
        return own if gained / total >= LEAST_REST else 0.0

    for turned, free, partner in ((False, free_s, partner_s), (True, free_r, partner_r)):
        if not free:
            continue
        # what a lone line may join, the best first, as each merge explains words that a later one can't claim again
        may: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for (i, j), shares in score.items():
            alone, other = (j, i) if turned else (i, j)
            if alone in free and shares[2 if turned else 1] >= LEAST_MERGE:
                may[alone].append((other, shares[2 if turned else 1]))

        def entry(alone: int, other: int, own: float, partner: dict = partner) -> tuple[bool, float, int, int]:
            near = any(other in partner[n] for n in (alone - 1, alone + 1) if n in partner)
            return not near, -own, alone, other

        heap = [entry(alone, other, own) for alone, found in may.items() for other, own in found]
        heapify(heap)
        while heap:
            top = heappop(heap)
            _, own, alone, other = top
            if alone not in free or top != entry(alone, other, -own) or not grows(alone, other, -own, turned):
                continue  # taken, now listed under another rank, or explained by others, which no merge undoes
            i, j = (other, alone) if turned else (alone, other)
            pairs.append((i, j))
            partner_s[i].append(j)
            partner_r[j].append(i)
            free.discard(alone)
            for n in (alone - 1, alone + 1):  # lines beside it now have a neighbour there
                if n in free:
                    for o, x in may.get(n, ()):
                        if o == other:
                            heappush(heap, entry(n, o, x))
    return sorted(set(pairs))


def read_lines(texts: DataFrame) -> DataFrame:
    """``texts`` (id, lang, src, ref) with the tokens of each line, parted by blanks, in place of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [["\n".join([" ".join(tokens(line)) for line in t.split("\n")]) for t in fold_array(batch.column(k)).to_pylist()] for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(r, pa.string()) for r in read)], ["id", "lang", "src", "ref"])

    return texts.mapInArrow(run, "id string, lang string, src string, ref string")


def _lines(texts: pa.Array) -> list[list[list[str]]]:
    return [[line.split() for line in t.split("\n")] for t in texts.to_pylist()]


def _none() -> Tables:
    return Tables([], {}, 1.0)


class Learned:
    """Word tables of all languages: ``pairs`` (lang, s, t, p), ``weights`` (lang, w, weight), ``common`` by language."""

    def __init__(self, pairs: DataFrame, weights: DataFrame, common: dict[str, float], most_entries: int):
        self.pairs, self.weights, self.common = pairs, weights, common
        self.held: dict[str, Tables] | None = None
        if pairs.count() + weights.count() <= most_entries:
            rows, weight = defaultdict(list), defaultdict(dict)
            for r in pairs.collect():
                rows[r.lang].append((r.s, r.t, r.p))
            for r in weights.collect():
                weight[r.lang][r.w] = r.weight
            self.held = {lang: Tables(rows[lang], weight[lang], c) for lang, c in common.items()}

    def aligned(self, texts: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run(lang, id, src lines, ref lines, tables)`` of each of ``texts`` (id, lang, src, ref), an iterator of rows."""
        held, common, names = self.held, self.common, [x.split()[0] for x in schema.split(", ")]

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                own = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True) if held is None else [None] * len(ids)
                for key, lang, one, two, more in zip(ids, langs, _lines(batch.column(2)), _lines(batch.column(3)), own, strict=True):
                    if held is not None:
                        tables = held.get(lang) or _none()
                    else:
                        tables = Tables([(r["s"], r["t"], r["p"]) for r in more[0] or []], {r["w"]: r["weight"] for r in more[1] or []}, common.get(lang, 1.0))
                    out.extend(run(lang, key, one, two, tables))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow_schema(schema))

        if held is None:
            texts = self._with_own(texts)
        return texts.mapInArrow(walk, schema)

    def _with_own(self, texts: DataFrame) -> DataFrame:
        """``texts`` with the table rows of their own words; what a document gets is bounded by its words."""

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for key, lang, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lines(batch.column(2)), _lines(batch.column(3)), strict=True):
                    for side, lines in enumerate((one, two)):
                        rows.extend((key, lang, side, w) for w in dict.fromkeys(t for line in lines for t in line) if not _is_number(w))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int8(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "side", "w"])

        of = checkpoint(texts.dropDuplicates(["id"]).mapInArrow(words, "id string, lang string, side byte, w string"))
        left, right = (of.filter(F.col("side") == k).select("id", "lang", F.col("w").alias(n)) for k, n in ((0, "s"), (1, "t")))
        pairs = left.join(self.pairs, ["lang", "s"]).join(right, ["id", "lang", "t"]).groupBy("id").agg(F.collect_list(F.struct("s", "t", "p")).alias("pairs"))
        weights = of.join(self.weights, ["lang", "w"]).groupBy("id").agg(F.collect_list(F.struct("w", "weight")).alias("weights"))
        return texts.join(pairs, "id", "left").join(weights, "id", "left").select("id", "lang", "src", "ref", "pairs", "weights")


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a short Spark schema string."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "byte": pa.int8()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


_PAIRS = "lang string, s string, t string, n long"


def _line_pairs(lang: str, src: list[list[str]], ref: list[list[str]], found: list[tuple[int, int]], counts: Counter) -> None:
    for i, j in found:
        counts[lang, *(" ".join([t for t in line if not _is_number(t)]) for line in (src[i], ref[j]))] += 1


def learn(texts: DataFrame, tables: Learned | None, most_entries: int = MOST_ENTRIES) -> Learned:
    """Tables by language from the line pairs of all texts (``read_lines``): ``first_pairs``, or an alignment."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, src, ref in zip(batch.column(1).to_pylist(), _lines(batch.column(2)), _lines(batch.column(3)), strict=True):
                _line_pairs(lang, src, ref, first_pairs(src, ref), counts)
            columns = [pa.array([k[i] for k in counts], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["lang", "s", "t", "n"])

    def again(lang: str, key: str, src: list[list[str]], ref: list[list[str]], of: Tables) -> list[tuple]:
        counts: Counter = Counter()
        _line_pairs(lang, src, ref, align(src, ref, of), counts)
        return [(*k, n) for k, n in counts.items()]

    lines = texts.mapInArrow(first, _PAIRS) if tables is None else tables.aligned(texts, again, _PAIRS)
    lines = checkpoint(lines.groupBy("lang", "s", "t").agg(F.sum("n").alias("n")))
    words = lines.select("lang", "n", *(F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")).alias(c) for c in ("s", "t")))
    whole = lines.groupBy("lang").agg(F.sum("n").alias("all"))
    of_s, of_t = (words.select("lang", "n", F.explode(c).alias(c)).groupBy("lang", c).agg(F.sum("n").alias(f"n{c}")) for c in ("s", "t"))
    size = F.size("t")
    around = (F.col("i") * size / F.greatest(F.col("_n"), F.lit(1)) - LONG / 2).cast("int")
    short = (F.col("_n") <= LONG) & (size <= LONG)
    part = F.slice("t", F.when(short, F.lit(1)).otherwise(F.greatest(F.lit(1), around)), F.when(short, size).otherwise(F.lit(LONG)))
    each = words.select("lang", "n", "t", F.size("s").alias("_n"), F.posexplode("s").alias("i", "s")).select("lang", "n", "s", F.explode(part).alias("t"))
    counted = each.groupBy("lang", "s", "t").agg(F.sum("n").alias("n")).filter("n > 1")

    def confidence(given: str, base: str) -> Column:
        rate = F.col(base) / F.col("all")
        return (F.col("n") / (F.col(given) + 2) - rate) / (1 - F.least(rate, F.lit(0.999)))

    pairs = counted.join(F.broadcast(whole), "lang").join(of_s, ["lang", "s"]).join(of_t, ["lang", "t"])  # few languages are known
    pairs = pairs.withColumn("p", F.greatest(confidence("ns", "nt"), confidence("nt", "ns"))).filter(F.col("p") >= LEAST_CONFIDENCE)
    best = [pairs.groupBy("lang", c).agg(F.max("p").alias(f"_{c}")) for c in ("s", "t")]
    pairs = pairs.join(best[0], ["lang", "s"]).join(best[1], ["lang", "t"]).filter(F.col("p") >= LEAST_OF_BEST * F.least("_s", "_t"))
    pairs = checkpoint(pairs.select("lang", "s", "t", F.least(F.lit(1.0), SHARPEN * F.col("p")).alias("p")))
    single = of_s.select("lang", F.col("s").alias("w"), F.col("ns").alias("n")).unionByName(of_t.select("lang", F.col("t").alias("w"), F.col("nt").alias("n")))
    single = single.groupBy("lang", "w").agg(F.max("n").alias("n")).join(F.broadcast(whole), "lang")
    weights = checkpoint(single.select("lang", "w", F.log(1 + F.col("all") / F.col("n")).alias("weight")))
    return Learned(pairs, weights, {r.lang: math.log(1 + r["all"]) for r in whole.collect()}, most_entries)


def align_documents(segments: DataFrame, key: str = "id", src: str = "src_text", ref: str = "ref_text", lang: str = "src_lang", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Columns id, src_line, ref_line (from 1) of documents with more than one line on a side.

    All texts with both sides serve to learn the tables. Null keys, null and empty texts take no part; a document
    delivered again gives its pairs once; unknown languages share one table. Empty tables give no row.
    """
    code = F.coalesce(language(lang), F.lit("?"))
    texts = segments.select(F.col(key).cast("string").alias("id"), code.alias("lang"), F.col(src).alias("src"), F.col(ref).alias("ref"))
    texts = texts.filter("id IS NOT NULL AND src <> '' AND ref <> ''")
    # few large files would leave most cores idle in the passes that follow
    parts = max(2 * texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    texts = texts.repartition(parts, F.xxhash64("id", "src", "ref")).dropDuplicates(["id", "lang", "src", "ref"])
    texts = checkpoint(read_lines(texts))
    tables = learn(texts, learn(texts, None, most_entries), most_entries)
    many = texts.filter(F.col("src").contains("\n") | F.col("ref").contains("\n"))

    def run(_: str, key: str, one: list[list[str]], two: list[list[str]], of: Tables) -> list[tuple]:
        return [(key, i + 1, j + 1) for i, j in align(one, two, of)]

    return tables.aligned(many, run, "id string, src_line long, ref_line long").distinct()
