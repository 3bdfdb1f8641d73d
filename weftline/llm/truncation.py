"""Problem 1: texts whose end is missing, by limits of length or a broken transfer.

Endings. A text without a closing mark is an open ending. It looks cut by what the corpus itself shows of its last
words: a last word that never stands inside any text, though others begin with it or no other text ends with it, a
last pair that should by chance but does not, or an ending after which the same words (from the start of the sentence,
else the last three, two, one) nearly always go on. Replacement characters, marks of omission and open brackets also
show a cut.

First test, limits. For each system and each source, in code points, bytes and words, the hazard of a length is the
share of texts whose end looks cut there among all texts at least as long. Window functions give each length its
neighbours' hazard, first with all lengths, then without the spikes found so far; a Chernoff bound of the binomial tail
gives its p-value, Benjamini-Hochberg the false-discovery threshold over all lengths tested. A length counts as
significant if most of its open endings look cut. At a significant length of a system every open ending is flagged,
and at one of a source each that is not mostly a stop elsewhere.

Second test, broken transfers. They cut at any length, which no hazard of lengths shows. For each open ending off the
significant lengths the hazard of a stop after its last words is tested against an even chance by the Chernoff bound,
with Benjamini-Hochberg over all endings tested; those that look cut and are significant are flagged. ``flagged``
says by ``at_limit`` which test a record comes from.

Words are hashed once per distinct word and batch; contexts are sums of word hashes by place (``Contexts``), so that
texts without any stop, and words of any length, take time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.charfold import fold_array, slices, to_codes
from weftline.session import checkpoint

#: False discoveries allowed among significant lengths, and the least hazard ratio to the neighbours.
FDR = 0.01
LEAST_RATIO = 5.0
#: Lengths to either side that count as neighbours.
NEIGHBOURS = 25
#: An ending after which the corpus stops in at most this share of cases is incomplete.
MOST_STOPS = 0.1  # a tenth of it where a mark closes the text after a digit
#: Occurrences from which a context's share counts: from the start of the sentence, and of three, two and one words.
LEAST_SEEN = (3, 8, 30, 100)
#: Times that a pair of words should stand inside a text by chance, so that its absence shows a cut.
LEAST_EXPECTED = 3.0
#: Share of the open endings of a significant length that look cut.
LEAST_CUT = 0.5
#: Contexts with more than this part of all endings are broadcast.
HOT = 1000
#: Bytes of text that the kernels take at once.
READ_BYTES = 4 << 20
#: False discoveries allowed among endings off the significant lengths.
FDR_ENDINGS = 0.01
#: Context counts that a task gathers before it hands them on.
_FLUSH = 1_000_000

_BLANK = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]+"
_OMISSION = r"(?:\s*(?:\.\.+|…|\[\s*(?:\.\.+|…)\s*\]|\(\s*(?:\.\.+|…)\s*\)))+$"
_CLOSING = pa.array(list(".!?)]\"'»“”’"))
_CLOSED, _NEUTRAL = 1, 2
#: State of an ending: closed, open, cut for certain, or a mark after a digit that may be cut from a number.
ENDS, HANGS, CUT, DIGIT = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15
_KINDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_START, _ONE, _TWO, _THREE, _PART = range(5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _from_start(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """At each place a hash of the values from the begin of its row; ``begin`` is the row's first place, per place."""
    powers = np.full(len(values) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    unpowers = np.full(len(values) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    unpowers[0] = 1
    unpowers = np.cumprod(unpowers)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    return (sums[1:] - sums[begin]) * unpowers[begin]


class Contexts:
    """The words of each row of an Arrow array, and the keys of contexts that end at each word."""

    def __init__(self, rows: pa.Array):
        split = pc.utf8_split_whitespace(rows.cast(pa.large_string()))
        self.offsets = split.offsets.to_numpy().astype(np.int64)
        self.offsets -= self.offsets[0]
        coded = split.flatten().dictionary_encode()
        self.known = coded.dictionary
        self.which = coded.indices.to_numpy()
        of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.known.to_pylist()), np.uint64, len(self.known))
        self.words = of[self.which] if len(of) else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.offsets))
        self.place = np.arange(len(self.words)) - self.offsets[self.row]

    def keys(self, kind: int, at: np.ndarray) -> np.ndarray:
        """Keys of one kind for words at ``at``: the last one, two or three words, or all from the row's start."""
        if kind == _START:
            value = _from_start(self.words, self.offsets[self.row])[at]
        else:
            value = self.words[at]
            for back in range(1, kind):
                value = value * np.uint64(_BASE) + self.words[at - back]
        return _mix(value + _KINDS[kind]).view(np.int64)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the beginnings of all distinct words, and whether a beginning is the whole word."""
        codes, ends = to_codes(self.known)
        row = np.repeat(np.arange(len(self.known)), np.diff(ends))
        keys = _mix(_from_start(_mix(codes.astype(np.uint64) + np.uint64(1)), ends[row]) + _KINDS[_PART]).view(np.int64)
        return keys, np.arange(len(codes)) + 1 == ends[row + 1]


def _pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Offsets of each text's pieces, the pieces in lower case with numbers masked, and whether a stop ends each."""
    masked = pc.utf8_lower(texts)
    for pattern, to in (
        (r"\p{Nd}+(?:[.,]\p{Nd}+)*|(?:[.,]\p{Nd}+)+", " 0 "),
        (r"([,:;])", r" \1 "),
        (r"([.!?])\s+", "\\1\x03\x01"),
        (r"\n+", "\x03\x01"),
        (r"\s*\(", "\x01"),
    ):
        masked = pc.replace_substring_regex(masked, pattern, to)
    parts = pc.split_pattern(masked, "\x01")
    flat = parts.flatten()
    stops = pc.ends_with(flat, "\x03")
    trimmed = pc.utf8_trim_whitespace(pc.if_else(stops, pc.utf8_rtrim(flat, "\x03.!? \n\t"), flat))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], trimmed, stops.to_numpy(zero_copy_only=False)


def read_endings(texts: pa.Array) -> tuple[np.ndarray, list[list[int]], pa.Array, np.ndarray, np.ndarray]:
    """State of each text's end, keys of its contexts (longest first, then the word before and the last word) if it
    hangs, and of all texts the pieces with known ends: piece, kind, row."""
    folded = fold_array(texts)
    body = pc.utf8_rtrim_whitespace(folded)
    bare = pc.utf8_rtrim(body, "\ufffd")
    broken = pc.not_equal(bare, body).to_numpy(zero_copy_only=False)
    last, two = pc.utf8_slice_codeunits(bare, -1), pc.utf8_slice_codeunits(bare, -2)
    maybe = pc.or_(pc.is_in(last, pa.array(["…", "]", ")"])), pc.equal(two, ".."))
    shown = bare
    if pc.any(maybe).as_py():
        shown = pc.replace_with_mask(bare, maybe, pc.replace_substring_regex(bare.filter(maybe), _OMISSION, ""))
    omission = pc.not_equal(shown, bare).to_numpy(zero_copy_only=False)
    bare = pc.utf8_rtrim_whitespace(shown)
    offsets, pieces, stops = _pieces(bare)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    ends = offsets[1:] - 1
    final = pc.utf8_slice_codeunits(bare, -1)
    empty = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    bracket = pc.match_substring_regex(bare, r"\([^)\n]*$|\[[^\]\n]*$").to_numpy(zero_copy_only=False)
    decimal = pc.match_substring_regex(pc.utf8_slice_codeunits(bare, -2), r"^\p{Nd}\.$").to_numpy(zero_copy_only=False)
    closing = pc.is_in(final, _CLOSING).to_numpy(zero_copy_only=False)
    stop = pc.is_in(final, pa.array([".", "!", "?"])).to_numpy(zero_copy_only=False)
    last_piece = pieces.take(pa.array(ends))
    stripped = pc.utf8_trim_whitespace(pc.utf8_rtrim(last_piece, ".!? "))
    wordless = pc.equal(pc.if_else(pa.array(decimal), stripped, last_piece), "").to_numpy(zero_copy_only=False)
    shut = ~empty & ~broken & ~bracket & closing & ~decimal
    hangs = ~empty & ~broken & ~bracket & ~shut & ~omission
    state = np.where(empty & ~broken & ~omission, ENDS, CUT)
    state[shut] = ENDS
    state[hangs] = np.where(decimal[hangs], np.where(wordless[hangs], ENDS, DIGIT), HANGS)
    # the last piece has a known end if a stop closes it, or seems to
    known = (shut & stop) | (hangs & decimal)
    kind = np.where(stops, _CLOSED, _NEUTRAL)
    kind[ends] = np.where(known, _CLOSED, 0)
    pieces = pc.replace_with_mask(pieces, pa.array(np.isin(np.arange(len(pieces)), ends[known])), stripped.filter(pa.array(known)))
    kept = (kind > 0) & pc.not_equal(pieces, "").to_numpy(zero_copy_only=False)
    contexts: list[list[int]] = [[] for _ in range(len(texts))]
    open_rows = np.flatnonzero(hangs & ~wordless)
    if len(open_rows):
        words = Contexts(pc.if_else(pa.array(decimal), stripped, last_piece).take(pa.array(open_rows)))
        at = words.offsets[1:] - 1
        keys = np.zeros((len(open_rows), 6), np.int64)
        for slot, back in ((_START, 1), (1, 3), (2, 2), (3, 1)):
            far = np.flatnonzero(words.place[at] >= back - 1)
            keys[far, slot] = words.keys((_START, _THREE, _TWO, _ONE)[slot], at[far])
        pairs = np.flatnonzero(words.place[at] >= 1)
        keys[pairs, 4] = words.keys(_ONE, at[pairs] - 1)
        parts, whole = words.parts()
        keys[:, 5] = parts[whole][words.which[at]]
        for r, k in zip(open_rows.tolist(), keys.tolist(), strict=True):
            contexts[r] = k
    return state, contexts, pieces.filter(pa.array(kept)), kind[kept], row[kept]


_READ = "key string, model string, source string, chars int, bytes int, words int, state byte, contexts array<long>, piece string, kind byte, n long"


def read_texts(df: DataFrame) -> DataFrame:
    """One pass over key, model, source, text: a row per non-empty text, and rows of counted pieces (key null)."""
    names = ["key", "model", "source", "chars", "bytes", "words", "state", "contexts", "piece", "kind", "n"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.list_(pa.int64()), pa.string(), pa.int8(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def counted() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by(["piece", "kind"]).aggregate([("n", "sum")]).combine_chunks()
            for part in summed.to_batches(max_chunksize=100_000):
                columns = [part.column("piece").cast(pa.string()), part.column("kind"), part.column("n_sum")]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(part.num_rows, k) for k in kinds[:8]), *columns], names)

        for batch in batches:
            for start, stop in slices(batch.column(3), READ_BYTES):
                part = batch.slice(start, stop - start)
                coded = part.column(3).cast(pa.large_string()).dictionary_encode()
                texts, which = coded.dictionary, coded.indices
                state, contexts, pieces, kind, row = read_endings(texts)
                seen = np.bincount(which.to_numpy(), minlength=len(texts))
                lengths = [pc.utf8_length(texts), pc.binary_length(texts), pc.count_substring_regex(texts, _BLANK)]
                own = [*lengths, pa.array(state), pa.array(contexts, kinds[7])]
                own = [x.cast(k).take(which) for x, k in zip(own, kinds[3:8], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *own, *(pa.nulls(part.num_rows, k) for k in kinds[8:])], names)
                held.append(pa.table({"piece": pieces, "kind": pa.array(kind, pa.int8()), "n": pa.array(seen[row], pa.int64())}))
                rows += len(pieces)
                if rows > _FLUSH // 4:
                    yield from counted()
                    held, rows = [], 0
        if held:
            yield from counted()

    return df.mapInArrow(run, _READ)


def context_counts(pieces: DataFrame) -> DataFrame:
    """Columns context, stops, goes, seen: how often the corpus stops or goes on after each context.

    ``seen`` counts places of another kind: before a bracket, and beginnings of longer words.
    """
    names = ["context", "stops", "goes", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys, slots, counts

        def out() -> Iterator[pa.RecordBatch]:
            keys, slots, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
            distinct, place = np.unique(keys, return_inverse=True)
            columns = [np.bincount(place, np.where(slots == i, counts, 0), len(distinct)).astype(np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, columns)], names)

        for batch in batches:
            words = Contexts(batch.column(0))
            n, closed = batch.column(2).to_numpy(), batch.column(1).to_numpy() == _CLOSED
            at = np.arange(len(words.words))
            final = at == words.offsets[words.row + 1] - 1
            slot = np.where(final, np.where(closed[words.row], 0, 2), 1)
            for kind in (_START, _ONE, _TWO, _THREE):
                far = at[words.place >= kind - 1]
                held.append((words.keys(kind, far), slot[far], n[words.row[far]]))
            parts, whole = words.parts()
            parts = np.unique(parts[~whole])
            held.append((parts, np.full(len(parts), 2), np.ones(len(parts), np.int64)))
            if sum(len(h[0]) for h in held) > _FLUSH:
                yield from out()
                held = []
        if held:
            yield from out()

    whole = pieces.groupBy("piece", "kind").agg(F.sum("n").alias("n"))
    found = whole.mapInArrow(run, "context long, stops long, goes long, seen long")
    return found.groupBy("context").agg(*(F.sum(c).alias(c) for c in names[1:]))


def log_tail(share: Column, n: Column, rate: Column) -> Column:
    """Chernoff bound of the logarithm of a binomial tail, for a ``share`` of ``n`` against ``rate``."""
    none = F.lit(0.0)
    hit, miss = F.when(share > 0, share * F.log(share / rate)).otherwise(none), F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(none)
    return -n * (hit + miss)


def discoveries(df: DataFrame, log_p: str, fdr: float) -> DataFrame:
    """The rows that Benjamini-Hochberg keeps, on p-values binned by their logarithm: few bins for any number of rows."""
    bin_ = F.ceil(F.greatest(F.col(log_p), F.lit(-700.0)) * 100)
    bins = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"))
    ranked = bins.select("bin", F.sum("k").over(Window.orderBy("bin")).alias("rank"), F.sum("k").over(Window.partitionBy()).alias("tests"))
    most = ranked.filter(F.col("bin") / 100.0 <= F.log(F.lit(fdr) * F.col("rank") / F.col("tests"))).agg(F.max("bin").alias("_most"))
    return df.crossJoin(F.broadcast(most)).filter(bin_ <= F.col("_most")).drop("_most")  # one row


def significant_lengths(lengths: DataFrame, fdr: float = FDR, ratio: float = LEAST_RATIO, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Lengths at which far more texts are cut than at neighbouring lengths.

    ``lengths``: scope, unit, length, n (texts), open (open endings), cut (endings that look cut). Columns: scope, unit, length, cut,
    at_risk, hazard, near (the neighbours' hazard) and p_value.
    """
    longer = Window.partitionBy("scope", "unit").orderBy(F.desc("length"))
    near = Window.partitionBy("scope", "unit").orderBy("length").rangeBetween(-neighbours, neighbours)
    rows = lengths.withColumn("at_risk", F.sum("n").over(longer)).filter("cut > 0").withColumn("hazard", F.col("cut") / F.col("at_risk"))

    def tested(df: DataFrame, spike: str) -> DataFrame:
        others = F.sum(F.when(~F.expr(spike), F.col("cut")).otherwise(0)).over(near) - F.when(~F.expr(spike), F.col("cut")).otherwise(0)
        spikes = F.sum(F.expr(spike).cast("int")).over(near) - F.expr(spike).cast("int")
        base = (others + F.lit(0.5)) / (F.col("at_risk") * (F.lit(2.0 * neighbours) - spikes))
        df = df.withColumn("near", F.least(base, F.lit(0.999)))
        h, q = F.col("hazard"), F.col("near")
        return df.withColumn("log_p", F.when(h > q, log_tail(h, F.col("at_risk"), q)).otherwise(0.0))

    first = tested(rows, "false").withColumn("spike", (F.col("log_p") < -14) & (F.col("hazard") >= 3 * F.col("near")))
    second = tested(first, "spike")
    kept = discoveries(second, "log_p", fdr)
    kept = kept.filter((F.col("hazard") >= F.lit(ratio) * F.col("near")) & (F.col("cut") >= LEAST_CUT * F.col("open")))
    return kept.select("scope", "unit", "length", "cut", "at_risk", "hazard", "near", F.exp("log_p").alias("p_value"))


def _scopes() -> Column:
    return F.explode(F.array(F.concat(F.lit("model:"), F.col("model")), F.concat(F.lit("source:"), F.col("source")))).alias("scope")


def _units() -> Column:
    return F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"), F.lit("words"), F.col("words"))).alias("unit", "length")


class Truncation:
    """Finds records with a missing end among key, text, model and source of ``df``.

    Null keys, null and blank texts take no part; repeated keys count once, by any of their rows. A null model or
    source is a scope of its own. An empty table gives no row.
    """

    def __init__(self, df: DataFrame, key: str = "eval_id", text: str = "hyp_text", model: str = "model", source: str = "source"):
        rows = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(model), F.lit("")).alias("model"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
        self.read = checkpoint(read_texts(rows.filter("key IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")))
        self.records = self.read.filter("key IS NOT NULL").drop("piece", "kind", "n")

    def words(self) -> int:
        """Number of words of all pieces."""
        counted = self.read.filter("key IS NULL").agg(F.sum((F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1) * F.col("n")))
        return counted.first()[0] or 0

    def endings(self) -> DataFrame:
        """Each record with an open ending: key, model, source, lengths, share (of stops), suspect (looks cut), log_p.

        What the corpus shows is worked out once per distinct ending, not per record: records of equal endings are
        counted before. A context that many distinct endings share, as a frequent last word, goes by a broadcast: those
        with more than a ``1 / HOT`` part of all are at most ``HOT`` in number.
        """
        if hasattr(self, "_endings"):
            return self._endings
        ends = self.records.filter(F.col("state") != ENDS).dropDuplicates(["key"])
        kinds = ends.filter(F.size("contexts") > 0).groupBy("state", "contexts").agg(F.count("*").alias("n"))
        kinds = checkpoint(kinds.withColumn("ending", F.xxhash64("state", "contexts")))
        each = kinds.select("ending", "state", "n", F.posexplode("contexts").alias("place", "context")).filter("context <> 0")
        bare = each.groupBy("context").agg(F.sum(F.when(F.col("state") == HANGS, F.col("n")).otherwise(0)).alias("bare"), F.count("*").alias("of"))
        known = context_counts(self.read.filter("key IS NULL").select("piece", "kind", "n"))
        every = checkpoint(bare.join(known, "context", "left").na.fill(0, ["stops", "goes", "seen"]))
        many = each.count()
        hot = F.broadcast(every.filter(F.col("of") * HOT > many))
        facts = each.join(hot, "context").unionByName(each.join(hot.select("context"), "context", "left_anti").join(every.filter(F.col("of") * HOT <= many), "context"))
        stops = F.col("stops") + F.col("bare") - 1  # without the ending itself
        fact = F.struct((F.col("stops") + F.col("goes") + F.col("seen")).alias("inside"), (stops + F.col("goes")).alias("total"), stops.alias("stops"))
        wide = facts.groupBy("ending", "state").agg(*(F.max(F.when(F.col("place") == i, fact)).alias(f"c{i}") for i in range(6)))
        share = F.coalesce(*(F.when(F.col(f"c{i}.total") >= LEAST_SEEN[i], F.col(f"c{i}.stops") / F.col(f"c{i}.total")) for i in range(4)))
        # a pair that never stands inside a text counts if, by its words' frequencies, it should have done so
        expected = F.col("c3.inside") * F.col("c4.inside") / F.lit(max(1, self.words()))
        # a word that stands only at ends may be rare and whole, unless another word begins with it
        begins = F.coalesce(F.col("c5.inside") > 0, F.lit(False)) | (F.col("c3.stops") <= 0)
        part = F.coalesce((F.col("c3.inside") == 0) & begins, F.lit(False))
        never = F.coalesce((F.col("c2.inside") == 0) & (expected >= LEAST_EXPECTED), F.lit(False))
        most = F.when(F.col("state") == DIGIT, MOST_STOPS / 10).otherwise(MOST_STOPS)
        # the strongest of the contexts that speak for a cut; a part of a word is none by chance, a pair by Poisson
        tails = [F.when((F.col(f"c{i}.total") > 0) & (F.col(f"c{i}.stops") <= most * F.col(f"c{i}.total")), log_tail(F.col(f"c{i}.stops") / F.col(f"c{i}.total"), F.col(f"c{i}.total"), F.lit(0.5))) for i in range(4)]
        log_p = F.least(F.lit(0.0), *tails, F.when(part, F.lit(-700.0)), F.when(never, -expected))
        wide = wide.select("ending", F.when(part | never, 0.0).otherwise(share).alias("share"), log_p.alias("log_p"))
        certain = (F.col("state") == CUT) | (F.size("contexts") == 0)
        rows = ends.withColumn("ending", F.xxhash64("state", "contexts")).join(wide, "ending", "left")
        rows = rows.withColumns({"share": F.when(certain, 0.0).otherwise(F.col("share")), "log_p": F.when(certain, -700.0).otherwise(F.coalesce("log_p", F.lit(0.0)))})
        rows = rows.withColumn("suspect", F.coalesce(F.col("share") <= most, F.lit(False)))
        self._endings = checkpoint(rows.select("key", "model", "source", "chars", "bytes", "words", "state", "share", "suspect", "log_p"))
        return self._endings

    def lengths(self) -> DataFrame:
        """Texts and endings that look cut by scope (system or source), unit and length."""

        def measured(df: DataFrame, count: str) -> DataFrame:
            few = df.groupBy("model", "source", "chars", "bytes", "words").agg(F.count("*").alias("c"))
            return few.select("*", _scopes()).select("scope", "c", _units()).groupBy("scope", "unit", "length").agg(F.sum("c").alias(count))

        on = ["scope", "unit", "length"]
        out = measured(self.records, "n").join(measured(self.endings().filter("suspect"), "cut"), on, "left")
        out = out.join(measured(self.endings().filter(F.col("state") != DIGIT), "open"), on, "left")
        return out.na.fill(0, ["cut", "open"])

    def limits(self) -> DataFrame:
        if not hasattr(self, "_limits"):
            self._limits = checkpoint(significant_lengths(self.lengths()))
        return self._limits

    def flagged(self) -> DataFrame:
        """Columns key, model, source, at_limit of each record that is flagged, by either test."""
        ends = self.endings()
        limits = self.limits().select("scope", "unit", "length").distinct()
        at = ends.select("key", "chars", "bytes", "words", _scopes()).select("key", "scope", _units())
        at = at.join(limits, ["scope", "unit", "length"], "left_semi").groupBy("key").agg(F.max(F.col("scope").startswith("model:")).alias("at_model"))
        rows = ends.join(at, "key", "left")
        mostly = F.coalesce(F.col("share") > 0.9, F.lit(False))  # a stop elsewhere
        on = rows.filter("at_model IS NOT NULL").filter(F.col("suspect") | ((F.col("at_model") | ~mostly) & (F.col("state") != DIGIT)))
        off = discoveries(rows.filter("at_model IS NULL"), "log_p", FDR_ENDINGS).filter("suspect")
        names = ["key", "model", "source"]
        return on.select(*names, F.lit(True).alias("at_limit")).unionByName(off.select(*names, F.lit(False).alias("at_limit")))

    def rates(self) -> DataFrame:
        """Columns scope, name, records, truncated, at_limit, rate: one row per system and one per source."""
        every = self.records.select("key", "model", "source").dropDuplicates(["key"])
        hit = self.flagged().select("key", "at_limit")
        rows = every.join(hit, "key", "left")
        both = rows.select(F.explode(F.create_map(F.lit("model"), F.col("model"), F.lit("source"), F.col("source"))).alias("scope", "name"), "at_limit")
        out = both.groupBy("scope", "name").agg(F.count("*").alias("records"), F.count("at_limit").alias("truncated"), F.sum(F.coalesce(F.col("at_limit").cast("long"), F.lit(0))).alias("at_limit"))
        return out.withColumn("rate", F.col("truncated") / F.col("records"))
