"""Problem 3: quantities recorded in different units, brought to one unit per dimension.

1. ``read_mentions`` reads every number with a unit of the grammar below, in digits or words, with the unit after the
   number, once after a list of dimensions, or once before it in brackets or after a colon.
2. ``unit_links`` links the same entity across sources: the k-th quantity of a segment's source text with the k-th
   of its reference and of each system's output, where both texts have as many. A source is a field of the segments
   of one origin, or a system.
3. ``unit_graph`` estimates for each linked pair of nodes (source, unit) the robust scale (mode of the log ratio, with
   the share of links that agree) and the offset of the line through the agreeing links, and snaps the scale to the
   nearest known conversion, a power of ten for the units of this grammar.
4. ``unit_scales`` propagates scales through the graph of nodes. What a unit's spelling says is where a node starts;
   trusted edges vote, and a node that its edges contradict takes the scale that they agree on. So a source that
   writes milligrams but means micrograms is put right, as is a unit whose spelling leaves its scale open.

The graph on the driver holds trusted edges between nodes (sources times units of a closed grammar), no links; more
than ``MOST_EDGES`` are an error rather than a cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.charforms import fold, level_map
from weftline.session import checkpoint

# Decimal exponents of unit prefixes, as symbols and as written in English, German and Turkish.
SYMBOLS = {"": 0, "k": 3, "d": -1, "c": -2, "m": -3, "μ": -6, "µ": -6, "u": -6}
WORDS = {"": 0, "kilo": 3, "deci": -1, "dezi": -1, "desi": -1, "centi": -2, "zenti": -2, "santi": -2, "milli": -3, "mili": -3, "micro": -6, "mikro": -6}
ACTIVE = {"": 0, "k": 3, "m": 6, "g": 9}
ACTIVE_WORDS = {"": 0, "kilo": 3, "mega": 6, "giga": 9}

# Names of the base units. The base of each dimension is 1 µm, 1 µg, 1 µl or 1 kBq.
LENGTH_NAMES = ("meter", "metern", "meters", "metre", "metres")
MASS_NAMES = ("gram", "grams", "gramm", "gramme", "grammes")
VOLUME_NAMES = ("liter", "litern", "liters", "litre", "litres")
ACTIVITY_NAMES = ("becquerel", "becquerels", "bekerel")

# Number words of English, German and Turkish.
NUMBER_WORDS = {
    1: "one ein eine einen einem einer eins bir",
    2: "two zwei iki",
    3: "three drei üç",
    4: "four vier dört",
    5: "five fünf beş",
    6: "six sechs altı",
    7: "seven sieben yedi",
    8: "eight acht sekiz",
    9: "nine neun dokuz",
    10: "ten zehn on",
    11: "eleven elf",
    12: "twelve zwölf",
    13: "thirteen dreizehn",
    14: "fourteen vierzehn",
    15: "fifteen fünfzehn",
    16: "sixteen sechzehn",
    17: "seventeen siebzehn",
    18: "eighteen achtzehn",
    19: "nineteen neunzehn",
    20: "twenty zwanzig yirmi",
    30: "thirty dreißig otuz",
    40: "forty vierzig kırk",
    50: "fifty fünfzig elli",
    60: "sixty sechzig altmış",
    70: "seventy siebzig yetmiş",
    80: "eighty achtzig seksen",
    90: "ninety neunzig doksan",
    100: "hundred hundert yüz",
}

DIMENSIONS = ("length", "mass", "volume", "activity")


class Unit(NamedTuple):
    token: str
    dimension: str
    exponent: int  # the known conversion: the token's unit is 10 ** exponent base units


@lru_cache(maxsize=1)
def units() -> tuple[Unit, ...]:
    """All unit tokens in lower case, in a fixed order; the place of a unit is its number."""
    out: dict[str, Unit] = {}

    def add(token: str, dimension: str, exponent: int) -> None:
        out.setdefault(token, Unit(token, dimension, exponent))

    for prefix, power in SYMBOLS.items():
        add(prefix + "m", "length", power + 6)
        add(prefix + "g", "mass", power + 6)
        add(prefix + "l", "volume", power + 6)
    for prefix, power in WORDS.items():
        for names, dimension in ((LENGTH_NAMES, "length"), (MASS_NAMES, "mass"), (VOLUME_NAMES, "volume")):
            for name in names:
                add(prefix + name, dimension, power + 6)
    for prefix, power in ACTIVE.items():
        add(prefix + "bq", "activity", power - 3)
    for prefix, power in ACTIVE_WORDS.items():
        for name in ACTIVITY_NAMES:
            add(prefix + name, "activity", power - 3)
    for token in ("gr", "gm"):
        add(token, "mass", 6)
    add("mcg", "mass", 0)
    for token in ("cc", "ccm", "cm3", "cm³"):
        add(token, "volume", 3)
    for token in ("mm3", "mm³"):
        add(token, "volume", 0)
    for token in ("dm3", "dm³"):
        add(token, "volume", 6)
    for word in ("kubikzentimeter", "cubic centimetre", "cubic centimetres", "cubic centimeter", "cubic centimeters", "santimetreküp"):
        add(word, "volume", 3)
    return tuple(out.values())


@lru_cache(maxsize=1)
def _number_words() -> dict[str, int]:
    """Numbers in words up to 999: the words above, and what English, German and Turkish compose of them by rule."""
    given = {n: words.split() for n, words in NUMBER_WORDS.items()}
    out = {w: n for n, words in given.items() for w in words}
    english, german, turkish = ({n: words[k] for n, words in given.items() if n < 100 and (k >= 0 or not 10 < n < 20)} for k in (0, 1, -1))
    tens = range(20, 100, 10)
    english |= {t + n: f"{english[t]} {english[n]}" for t in tens for n in range(1, 10)}
    german |= {t + n: f"{german[n]}und{german[t]}" for t in tens for n in range(1, 10)}
    turkish |= {t + n: f"{turkish[t]} {turkish[n]}" for t in (10, *tens) for n in range(1, 10)}
    for words, hundred, gap, joints in ((english, "hundred", " ", (" ", " and ")), (german, "hundert", "", ("", "und")), (turkish, "yüz", " ", (" ",))):
        out |= {w: n for n, w in words.items()}
        for h in range(1, 10):
            for head in [words[h] + gap + hundred, *([hundred] if h == 1 else [])]:
                out[head] = 100 * h
                out |= {head + joint + w: 100 * h + n for n, w in words.items() for joint in joints}
    return out | {w.replace(" ", "-"): n for w, n in out.items() if w.split(" ")[0] in english.values() and w.count(" ") == 1 and n < 100}


def _either(words: Iterable[str]) -> str:
    """A pattern of the words that branches by first letter, longest first."""
    by: dict[str, list[str]] = {}
    for word in sorted(words, key=lambda x: (-len(x), x)):
        by.setdefault(word[0], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in sorted(by.items()))


class _Grammar:
    def __init__(self) -> None:
        self.number = {u.token: i for i, u in enumerate(units())}
        self.words = _number_words()
        self.single_words = frozenset(re.split("[ -]", w)[0] for w in self.words)
        unit = f"(?:{_either(self.number)})(?![^\\W_])(?! ?/ ?[^\\W\\d_])"
        count = r"(?:\d+(?:[.,]\d+)*|[.,]\d+)"
        times = r"(?: ?[x×*] ?| (?:by|mal|times) |[-–](?=[\d.,]))"
        own = f"(?: ?-? ?{unit})?"
        self.item = re.compile(f"({count})(?: ?-? ?({unit}))?")
        # begins with a digit, so that the scan skips from digit to digit
        self.listed = re.compile(f"\\d+(?:[.,]\\d+)*{own}(?:{times}{count}{own})*")
        self.before = re.compile(f"(?:\\[ ?({unit}) ?\\] ?:?|\\( ?({unit}) ?\\) ?:|(?<![^\\W_])in ({unit}) ?:) ?$")
        words = f"(?:{_either(self.words)})(?![^\\W_])"
        self.worded = re.compile(f"(?<![^\\W_])({words})(?= ?-? ?{unit}|{times}(?:{count}|{words}))")


@lru_cache(maxsize=1)
def _grammar() -> _Grammar:
    return _Grammar()


_MARKS = re.compile(r"[.,]")
_LEADS = ("]", ")", ":")
_PART = re.compile("\0")


@lru_cache(maxsize=1)
def _odd() -> frozenset[str]:
    """What the consistent form changes, marks and all, but not the micro sign, which the grammar reads itself."""
    marks = [chr(c) for a, b in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100)) for c in range(a, b)]
    return frozenset([*marks, *(chr(c) for c in level_map() if c != 0xB5)])


#: Decimals beyond these, on either side, make no other value in 64 bits.
MOST_DECIMALS = 1000


def read_number(text: str) -> tuple[int, int]:
    """Digits and number of decimals of a number in digits or words: (25, 1) for 2,5.

    A mark followed by exactly three digits groups thousands if digits stand before it. Of more than 18 digits the
    leading 18 are kept and the decimals become fewer, below zero for large whole numbers, so that every number has a
    value and fits 64 bits.
    """
    words = _grammar().words
    if text in words:
        return words[text], 0
    parts = _MARKS.split(text)
    whole, decimals = parts[0], ""
    for k, part in enumerate(parts[1:]):
        if len(part) == 3 and whole:
            whole += part
        elif k == len(parts) - 2:
            decimals = part
        else:
            whole += part
    digits = "".join(str(unicodedata.digit(c)) for c in whole + decimals) if not (whole + decimals).isascii() else whole + decimals
    if len(digits) <= 18:
        return int(digits or "0"), len(decimals)
    short = digits.lstrip("0")[:18]
    return int(short or "0"), max(-MOST_DECIMALS, min(MOST_DECIMALS, len(decimals) - len(digits.lstrip("0")) + len(short)))


#: Quantities of number lists that were read before, by the list as written; emptied when it grows beyond its bound.
_SPANS: dict[str, tuple[tuple[int, int, int], ...]] = {}
_MOST_SPANS = 1 << 17


def _listed(span: str) -> tuple[tuple[int, int, int], ...]:
    """The quantities of one list of numbers, as far as units stand in it."""
    g = _grammar()
    items = g.item.findall(span)
    if items[-1][1]:
        unit, found = None, []
        for n, own in reversed(items):  # a unit holds for the numbers of its list before it
            unit = g.number[own] if own else unit
            found.append((unit, *read_number(n)))
        return tuple(reversed(found))
    return tuple((g.number[own], *read_number(n)) for n, own in items if own)


def mentions_of(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The quantities of each text in order: (number of the unit, digits, decimals).

    The texts are read as one string, so that the scan over all of them is one call; a null character, which no list of
    numbers goes across, parts them.
    """
    odd, g = _odd(), _grammar()
    parts = []
    for t in texts:
        t = (t if t.isascii() or odd.isdisjoint(t) else fold(t)).lower()
        if not g.single_words.isdisjoint(t.replace("(", " ").replace("-", " ").split()):
            t = g.worded.sub(lambda m: str(g.words[m[1]]), t)
        parts.append(t.replace("\0", " "))
    whole = "\0".join(parts)
    ends = [m.start() for m in _PART.finditer(whole)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    row, end = 0, ends[0] if ends else len(whole)
    for m in g.listed.finditer(whole):
        span = m[0]
        start = m.start()
        last = whole[start - 1] if start else " "
        if last != " " and last != "\n" and last != "(":
            if last.isalnum():
                continue
            if last in ".,/:-–" and start > 1:
                if whole[start - 2].isdigit():
                    continue
                if last in ".," and not whole[start - 2].isalnum():
                    span = last + span
            elif last in ".,":
                span = last + span
        found = _SPANS.get(span)
        if found is None:
            if len(_SPANS) >= _MOST_SPANS:
                _SPANS.clear()
            found = _SPANS[span] = _listed(span)
        if not found and start and (last in _LEADS or (last == " " and whole[start - 2 : start - 1] in _LEADS)):
            lead = whole[max(0, start - 40) : start].rstrip(" .,")  # the unit stands before its list
            before = g.before.search(lead)
            if before and not whole[m.end() : m.end() + 1].isalpha():
                unit = g.number[before[1] or before[2] or before[3]]
                found = [(unit, *read_number(n)) for n, _ in g.item.findall(span)]
        if found:
            while start > end:
                row += 1
                end = ends[row] if row < len(ends) else len(whole)
            out[row] += found
    return out


def mentions(text: str | None) -> list[tuple[int, int, int]]:
    """The quantities of one text; nothing for null or empty."""
    return mentions_of([text])[0] if text else []


MENTION = "units array<short>, digits array<long>, decimals array<short>"


def read_mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with the quantities of ``text`` as three arrays; rows without any are left out."""
    others = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), MENTION])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.dictionary_encode(batch.column(batch.schema.get_field_index(text)))
            read = mentions_of(texts.dictionary.to_pylist())
            rows, ends, flat = [], [0], []
            for i, k in enumerate(texts.indices.to_pylist()):
                if k is not None and read[k]:
                    rows.append(i)
                    flat.extend(read[k])
                    ends.append(len(flat))
            at, offsets = pa.array(rows, pa.int64()), pa.array(ends, pa.int32())
            columns = [batch.column(batch.schema.get_field_index(f.name)).take(at) for f in others]
            for k, kind in enumerate((pa.int16(), pa.int64(), pa.int16())):
                columns.append(pa.ListArray.from_arrays(offsets, pa.array([x[k] for x in flat], kind)))
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in others), "units", "digits", "decimals"])

    return df.mapInArrow(run, schema)


#: Edges of the unit graph that the driver holds at most.
MOST_EDGES = 1_000_000
#: Links from which an edge is trusted, share of them that agree, and links of an edge that speaks against a spelling.
LEAST_LINKS, LEAST_SHARE, LEAST_AGAINST = 3, 0.6, 10
# Units whose spelling names no prefix, so that one trusted edge decides their scale.
OPEN_UNITS = ("gr", "gm", "cc", "mcg")


class Node(NamedTuple):
    source: str
    unit: int


class Edge(NamedTuple):
    """Links between two nodes: value_b = 10 ** power * value_a + offset for the same quantity."""

    a: Node
    b: Node
    n: int
    share: float
    power: int
    offset: float


def unit_links(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Links of the same entity in two sources: source, unit and value of either side, positive values only.

    The k-th quantity of one text is linked with the k-th of the other if the two texts of an entity hold as many.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(on), F.col("source").alias(f"source_{name}"), F.arrays_zip("units", "digits", "decimals").alias(name))

    both = side(a, "a").join(side(b, "b"), on).filter(F.size("a") == F.size("b"))
    pairs = both.select("source_a", "source_b", F.explode(F.arrays_zip("a", "b")).alias("p")).filter("p.a.digits > 0 AND p.b.digits > 0")
    value = lambda of: F.col(f"p.{of}.digits") * F.pow(F.lit(10.0), -F.col(f"p.{of}.decimals"))
    return pairs.select("source_a", F.col("p.a.units").alias("unit_a"), "source_b", F.col("p.b.units").alias("unit_b"), value("a").alias("value_a"), value("b").alias("value_b"))


def unit_graph(links: DataFrame, least_links: int = LEAST_LINKS, least_share: float = LEAST_SHARE) -> list[Edge]:
    """The trusted edges between nodes: enough links that agree, a scale that snaps to a power of ten, no offset."""
    nodes = ["source_a", "unit_a", "source_b", "unit_b"]
    log = F.log10(F.col("value_b") / F.col("value_a"))
    ends = [f(c).alias(f"{n}_{c[-1]}") for c in ("value_a", "value_b") for n, f in (("lo", F.min), ("hi", F.max))]
    near = links.groupBy(*nodes, F.round(log, 2).alias("lr")).agg(F.count("*").alias("n"), *ends)
    rows = near.groupBy(*nodes).agg(F.sum("n").alias("n"), F.max_by(F.struct("lr", "n", "lo_a", "hi_a", "lo_b", "hi_b"), F.struct("n", -F.abs("lr"))).alias("mode"))
    trusted = rows.filter((F.col("n") >= least_links) & (F.col("mode.n") >= least_share * F.col("n")) & (F.abs(F.col("mode.lr") - F.round("mode.lr")) <= 0.02))
    found = trusted.limit(MOST_EDGES + 1).collect()
    if len(found) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges between sources and units")
    out = []
    for r in found:
        mode, offset = r["mode"], 0.0
        if mode["hi_a"] > mode["lo_a"]:
            slope = (mode["hi_b"] - mode["lo_b"]) / (mode["hi_a"] - mode["lo_a"])
            offset = mode["lo_b"] - slope * mode["lo_a"]
        if abs(offset) <= 0.02 * max(abs(mode["lo_b"]), 1e-9):
            out.append(Edge(Node(r["source_a"], r["unit_a"]), Node(r["source_b"], r["unit_b"]), r["n"], mode["n"] / r["n"], round(mode["lr"]), 0.0))
    return out


def unit_scales(graph: list[Edge], least_against: int = LEAST_AGAINST) -> dict[Node, tuple[int, bool]]:
    """Node to (exponent, whether an edge confirms it) of all nodes with trusted edges.

    All nodes start at what their spelling says. The exponent that a node's edges agree on, by number of agreeing
    links, is put in place of its own if that has less support; the node with the most to gain goes first, so each
    step raises the support of the whole and the search ends. As a pair of nodes may be linked wrongly throughout, it
    takes two edges of ``least_against`` links to go against a spelling, and one where the spelling names no prefix.
    Edges between dimensions are no conversion.
    """
    all_units = units()
    ways: dict[Node, list[tuple[Node, int, Edge]]] = {}
    for e in graph:
        if all_units[e.a.unit].dimension == all_units[e.b.unit].dimension and e.a != e.b:
            # value_b = 10 ** power * value_a for the same quantity, so one unit a is 10 ** power units b
            ways.setdefault(e.a, []).append((e.b, e.power, e))
            ways.setdefault(e.b, []).append((e.a, -e.power, e))
    at = {node: all_units[node.unit].exponent for node in ways}

    def change(node: Node) -> tuple[float, int]:
        votes: dict[int, float] = {}
        strong: dict[int, int] = {}
        for other, step, e in ways[node]:
            exponent = at[other] + step
            votes[exponent] = votes.get(exponent, 0.0) + e.n * e.share
            strong[exponent] = strong.get(exponent, 0) + (e.n >= least_against)
        support, exponent = max((v, x) for x, v in votes.items())
        needed = 1 if all_units[node.unit].token in OPEN_UNITS else 2
        gain = support - votes.get(at[node], 0.0)
        return (gain, exponent) if gain > 0 and exponent != at[node] and strong[exponent] >= needed else (0.0, at[node])

    wanted = {node: change(node) for node in ways}
    while True:
        node = max(wanted, key=lambda x: (wanted[x][0], x), default=None)
        if node is None or wanted[node][0] <= 0:
            break
        at[node] = wanted[node][1]
        for other in {node, *(o for o, _, _ in ways[node])}:
            wanted[other] = change(other)
    return {node: (at[node], any(at[o] + step == at[node] for o, step, _ in ways[node])) for node in ways}


def base_values(read: DataFrame, scales: dict[Node, tuple[int, bool]], keys: list[str]) -> DataFrame:
    """Distinct (keys, dimension, base_value) of ``read_mentions`` rows under the given scales.

    A value that is no whole number of base units is rounded half up; one beyond 64 bits gives a row with null.
    """
    all_units = units()
    place = F.array(*[F.lit(DIMENSIONS.index(u.dimension)) for u in all_units])
    power = F.array(*[F.lit(u.exponent) for u in all_units])
    names = F.array(*[F.lit(d) for d in DIMENSIONS])
    rows = read.select(*keys, "source", F.explode(F.array_distinct(F.arrays_zip("units", "digits", "decimals"))).alias("m"))
    spelled = F.element_at(power, F.col("m.units").cast("int") + 1)
    other = [(*node, exponent) for node, (exponent, _) in scales.items() if exponent != all_units[node.unit].exponent]
    if other:  # nodes whose links speak against the spelling; a small table, whose size decides how it is joined
        learned = read.sparkSession.createDataFrame(other, "source string, _unit short, _exponent int")
        rows = rows.withColumn("_unit", F.col("m.units")).join(learned, ["source", "_unit"], "left")
        spelled = F.coalesce("_exponent", spelled)
    shift = spelled - F.col("m.decimals")
    tens = F.array(*[F.lit(10**k) for k in range(19)])
    ten = lambda k: F.element_at(tens, F.least(F.greatest(k, F.lit(0)), F.lit(18)).cast("int") + 1)
    digits, down = F.col("m.digits"), ten(-shift)
    up = F.when(digits == 0, F.lit(0).cast("long")).when(shift <= 18, F.try_multiply(digits, ten(shift)))
    rest = digits % down
    half_up = F.when(shift < -18, F.lit(0).cast("long")).otherwise(F.call_function("div", digits, down) + (2 * rest >= down).cast("long"))
    dimension = F.element_at(names, F.element_at(place, F.col("m.units").cast("int") + 1) + 1)
    return rows.select(*keys, dimension.alias("dimension"), F.when(shift >= 0, up).otherwise(half_up).alias("base_value")).distinct()


def read_all(segments: DataFrame, evaluations: DataFrame) -> DataFrame:
    """field, rec_key, entity, source and the quantities of every text, as a checkpoint of narrow rows.

    The source of a segment's texts is their field with the segment's ``source``, that of an output its ``model``; tables
    without these columns are one source each.
    """

    def texts(df: DataFrame, field: str, key: str, source: str) -> DataFrame:
        of = F.coalesce(F.col(source), F.lit("")) if source in df.columns else F.lit("")
        return df.select(F.lit(field).alias("field"), F.col(key).alias("rec_key"), F.col("id").alias("entity"), F.concat(F.lit(f"{field}:"), of).alias("source"), F.col(field).alias("text"))

    parts = texts(segments, "src_text", "id", "source").unionByName(texts(segments, "ref_text", "id", "source")).unionByName(texts(evaluations, "hyp_text", "eval_id", "model"))
    return checkpoint(read_mentions(parts.filter("rec_key IS NOT NULL AND text IS NOT NULL")))


def learned_graph(read: DataFrame) -> list[Edge]:
    """The unit graph of ``read_all``: source texts linked with references and system outputs."""
    sources = read.filter("field = 'src_text' AND entity IS NOT NULL").dropDuplicates(["entity"])
    return unit_graph(unit_links(sources, read.filter("field <> 'src_text'"), "entity"))


def quantities(segments: DataFrame, evaluations: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """Columns field, rec_key, dimension, base_value of segments (src_text, ref_text) and evaluations (hyp_text).

    ``left_out`` holds the ``eval_id`` of evaluations whose text is not read. Null keys, null and empty texts have
    no quantity; a redelivered row adds none if its text is the same. Empty tables give no row.
    """
    read = read_all(segments, evaluations)
    scales = unit_scales(learned_graph(read))
    if left_out is not None:
        gone = left_out.select(F.lit("hyp_text").alias("field"), F.col("eval_id").alias("rec_key")).distinct()
        read = read.join(gone, ["field", "rec_key"], "left_anti")
    return base_values(read, scales, ["field", "rec_key"])
