import random
import time

import numpy as np
import pyarrow as pa

from weftline.llm import truncation as t

ORGANS = ["left lower lobe", "right kidney", "left hip joint", "right breast", "liver", "urinary bladder"]
FINDINGS = ["atelectasis", "fracture", "haemangioma", "effusion", "stenosis"]


def report(rng):
    out = []
    for _ in range(rng.randint(4, 9)):
        organ, finding, n = rng.choice(ORGANS), rng.choice(FINDINGS), rng.randint(2, 90)
        out.append(
            rng.choice(
                [
                    f"Suspected {finding} in the {organ}; follow-up in {n} months.",
                    f"Since 2021-0{rng.randint(1, 9)}-12 the finding in the {organ} is unchanged.",
                    f"The {organ} shows mild {finding}.",
                    f"A {n} mm nodule in the {organ}.",
                    "Findings:",
                ]
            )
        )
    return "\n".join(out)


def corpus():
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(3000):
        text, model, source = report(rng), f"m{i % 3}", ("parrot", "legacy")[i % 10 == 0]
        key = f"e{i}"
        if model == "m0" and len(text) > 150:
            whole = text[:150].rstrip()[-1] in ".:"  # ends with a whole sentence or heading: not a case
            text = text[:150] + ("…" if i % 2 else "")
            if not whole:
                cut.add(key)
        elif i % 97 == 5:
            end = rng.randint(30, len(text) - 12)
            while not text[end - 1].isalpha() or not text[end].isalpha():
                end -= 1
            text = text[:end]
            cut.add(key)
        elif i % 40 == 7:
            text = text.rstrip(".")
        rows.append((key, text, model, source))
    return rows, cut


def test_finds_limits_and_broken_transfers(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([*rows, rows[0], ("n", None, "m1", "parrot"), ("b", " ", "m1", None), (None, "x", "m1", "s")], "eval_id string, hyp_text string, model string, source string")
    df = df.selectExpr("*", "1 AS state", "2 AS n", "3 AS share").repartition(4)
    found = t.Truncation(df)
    limits = {(r["scope"], r["unit"], r["length"]) for r in found.limits().collect()}
    assert ("model:m0", "chars", 150) in limits and not any(s in ("model:m1", "model:m2") for s, _, _ in limits)
    got = {r["key"] for r in found.flagged().collect()}
    assert len(got & cut) / len(cut) > 0.97 and len(got & cut) / len(got) > 0.97
    rates = {(r["scope"], r["name"]): r for r in found.rates().collect()}
    assert rates["model", "m0"]["records"] == 1000 and rates["model", "m0"]["rate"] > 0.5 > 0.05 > rates["model", "m1"]["rate"]


def ending(text):
    state, contexts, pieces, kind, row = t.read_endings(pa.array(["Other text (see", text]))
    return int(state[1]), contexts[1], [(p, k) for p, k, r in zip(pieces.to_pylist(), kind.tolist(), row.tolist(), strict=True) if r == 1]


def test_endings():
    assert ending("All clear.")[0] == t.ENDS and ending("(Ref. 12)")[0] == t.ENDS and ending("Done. ...")[0] == t.ENDS
    assert ending("size [m")[0] == t.CUT and ending("in the l\ufffd")[0] == t.CUT and ending("in th ...")[0] == t.CUT
    assert ending("measuring 7.")[0] == t.DIGIT and ending("in the left")[0] == t.HANGS
    state, keys, pieces = ending("One two.\nFindings:\nAge 5, que")
    assert state == t.HANGS and len(keys) == 6 and pieces == [("one two", 1), ("findings :", 1)]


def test_long_words_and_texts_without_stops_are_read_whole_in_proportion():
    began = time.perf_counter()
    assert ending("x" * 2_000_000)[0] == t.HANGS
    state, keys, _ = ending("word " * 400_000)
    assert state == t.HANGS and all(keys)
    words = t.Contexts(pa.array(["a b c d", "c d", "b c d"]))
    last = words.offsets[1:] - 1
    assert len(set(words.keys(t._TWO, last).tolist())) == 1 and len(set(words.keys(t._START, last).tolist())) == 3
    assert words.keys(t._THREE, last[[0, 2]]).tolist()[0] == words.keys(t._THREE, last[[2]]).tolist()[0]
    assert time.perf_counter() - began < 20


def test_context_counts_equal_a_plain_count(spark):
    rng = random.Random(3)
    pieces = [(" ".join(rng.choice("ab cde fg abc".split()) for _ in range(rng.randint(1, 6))), rng.randint(1, 2), rng.randint(1, 4)) for _ in range(200)]
    got = {r["context"]: (r["stops"], r["goes"], r["seen"]) for r in t.context_counts(spark.createDataFrame(pieces, "piece string, kind byte, n long")).collect()}
    for context in ("ab", "cde fg", "ab ab cde"):
        words = context.split()
        key = t.Contexts(pa.array([context])).keys(len(words), np.array([len(words) - 1]))[0]
        want = [0, 0, 0]
        for piece, kind, n in pieces:
            have = piece.split()
            for i in range(len(words), len(have) + 1):
                if have[i - len(words) : i] == words:
                    want[1 if i < len(have) else 0 if kind == 1 else 2] += n
        assert got.get(key, (0, 0, 0)) == tuple(want)


def test_frequent_contexts_give_the_same_by_broadcast(spark, monkeypatch):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "eval_id string, hyp_text string, model string, source string")
    got = []
    for hot in (0, 1 << 40):
        monkeypatch.setattr(t, "HOT", hot)
        got.append({(r["key"], r["suspect"], round(r["log_p"], 6)) for r in t.Truncation(df).endings().collect()})
    assert got[0] == got[1] and len(got[0]) > 100


def test_significant_lengths_follow_the_excess(spark):
    rows = [("s", "chars", n, 10, 0, 0) for n in range(1, 200)] + [("s", "chars", 200, 90, 80, 80), ("s", "chars", 230, 5, 1, 1)]
    df = spark.createDataFrame(rows, "scope string, unit string, length int, n long, cut long, open long")
    assert [r["length"] for r in t.significant_lengths(df).collect()] == [200]
    assert t.significant_lengths(df.limit(0)).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "eval_id string, hyp_text string, model string, source string")
    assert t.Truncation(df).flagged().count() == 0 and t.Truncation(df).rates().count() == 0
