import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from weftline.functions.charforms import fold, level_map
from weftline.llm.charfold import fold_array, fold_codes, from_codes, look_pairs, slices, to_codes

ODD = "Ａ１ аеосԁ ﬁﬀ ́̈̆̀ ̧ äé   　​⁠﻿­ ³ß ıİ αβ µ … ‑ \r\n\t 가ᄀ각 ᆨ 𝐀 😀 ẩ"


def test_equals_the_plain_form_on_random_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD + "abc oAe") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert fold_array(pa.array(texts)).to_pylist() == [fold(t) for t in texts]


def test_equals_the_plain_form_on_every_code_point():
    texts = [chr(c) + "x" + chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    got = fold_array(pa.array(texts)).to_pylist()
    assert [t for t, g in zip(texts, got) if g != fold(t)] == []


def test_round_trip_and_slices():
    array = pa.array(["ab", None, "ü€😀", ""])
    assert from_codes(*to_codes(array)).to_pylist() == ["ab", "", "ü€😀", ""]
    assert fold_array(pa.array(["x", "Ａ", None, "ｂ​"]).slice(1)).to_pylist() == ["A", None, "b"]
    assert fold_codes(np.zeros(0, np.uint32), np.array([0, 0]))[1].tolist() == [0, 0]


def test_what_a_reader_sees_stays():
    for text in ["Maß", "cm³", "ısı", "a\nb", "β-Blocker", "×", "A–B"]:
        assert fold(text) == text
    assert all(fold(to) == to for to in level_map().values() if to)


def test_look_pairs(spark):
    rows = [("b", "g", "Ａb"), ("a", "g", "Ab"), ("c", "g", "Ab"), ("c", "g", "Ab"), ("d", "h", "Ab"), ("e", "g", None), (None, "g", "Ab"), ("f", "g", ""), ("k", "g", "​")]
    df = spark.createDataFrame(rows, "k string, g string, t string").selectExpr("*", "1 AS _text", "2 AS key_a")
    got = {tuple(r) for r in look_pairs(df, "k", "t", df["g"]).collect()}
    assert got == {("a", "b"), ("b", "c"), ("f", "k")}
    assert {tuple(r) for r in look_pairs(df, "k", "t").collect()} == got | {("b", "d")}
    assert look_pairs(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("text", ["", "a" * 300_000 + "ｂ"])
def test_sizes(text):
    assert fold_array(pa.array([text])).to_pylist() == [fold(text)]


def test_slices_hold_every_row_once():
    texts = pa.array(["a" * n for n in (3, 0, 9, 1, 1, 1, 20, 0)] + [None]).slice(1)
    assert list(slices(texts, 10)) == [(0, 3), (3, 5), (5, 6), (6, 8)]
    assert list(slices(texts.slice(0, 0), 10)) == []


def test_a_form_of_most_rows_is_made_in_parts(spark):
    rows = [(f"k{i:03d}", "Erguss links" if i % 3 else "Erguss\u00a0links") for i in range(120)] + [("z", "anders")]
    df = spark.createDataFrame(rows, "id string, t string")
    whole, parts = ({tuple(r) for r in look_pairs(df, "id", "t", hot_rows=n).collect()} for n in (1000, 7))
    assert whole == parts and len(whole) == 40 * 80
