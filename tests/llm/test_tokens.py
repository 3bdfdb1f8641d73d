import math
import random

import pytest
import tiktoken
from tokenizers import Tokenizer, models

from weftline.llm import tokens

TEXTS = ["", " ", "Kein Pneumothorax.", "Überschreiten Sie nicht 80 mg!", "Sağ üst lobda 12 mm nodül\n\n\n x", "a" * 300, "  tabs\t\tand 1234567890 ", "😀 ｆｕｌｌ", "it's we'll I'd", "ₒ́​", "日本語テキスト"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_merge_counts_equal_the_encoder(name):
    own = tokens.counter(name)
    encoder = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeilnrstu äöüßğ.,0123456789\n") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    assert [own.count(t) for t in texts] == [len(encoder.encode_ordinary(t)) for t in texts]


def test_unigram_counts_equal_the_model():
    rng = random.Random(1)
    pieces = {c for c in "abcd▁"} | {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 4))) for _ in range(60)} | {"▁ab", "▁c", "▁dab"}
    vocabulary = [("<unk>", -50.0)] + [(p, -math.log(2 + rng.random() * 50)) for p in sorted(pieces)]
    model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    own = tokens.UnigramCounter(vocabulary[1:], space=None)
    for _ in range(500):
        text = "".join(rng.choice("abcd▁") for _ in range(rng.randint(0, 30)))
        assert own.count(text) == len(model.encode(text).ids)
    spaced = tokens.UnigramCounter(vocabulary[1:])
    assert spaced.apart and spaced.count("ab cd") == own.count("▁ab▁cd")
    assert own.count("axb") == own.count("a") + 1 + own.count("b")


def test_trie_holds_exactly_its_keys():
    rng = random.Random(2)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))) for _ in range(3000)})
    base, check, value = tokens.DoubleArrayTrie(keys).lists()

    def find(key):
        state = 0
        for b in key:
            to = base[state] + b + 1
            if to >= len(check) or check[to] != state:
                return -1
            state = to
        return value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"\x00\x01\x02\x03\x04\x05") == -1 for k in keys[:100])


def test_budget_takes_each_segment_once(spark):
    rows = [
        ("a", "EMEA", "de", "emea", "2024-01-02 00:00:00", "ein Text"),
        ("a", None, " DEU", "emea", "2024-01-01 00:00:00", "ein Text"),
        ("b", "", "xx", "himl", "2024-01-01 00:00:00", None),
        ("c", "emea", "German", "emea", None, ""),
        (None, "emea", "de", "emea", None, "x"),
    ]
    df = spark.createDataFrame(rows, "id string, domain string, src_lang string, source string, t string, src_text string")
    df = df.selectExpr("id", "domain", "src_lang", "source", "cast(t as timestamp) loaded_at", "src_text", "1 AS n_tokens", "2 AS lang")
    got = {tuple(r) for r in tokens.segment_tokens(df).select("id", "source", "lang", "domain", "n_tokens", "n_chars").collect()}
    n = tokens.counter().count("ein Text")
    assert got == {("a", "emea", "de", "emea", n, 8), ("b", "himl", "unknown", "unspecified", 0, 0), ("c", "emea", "de", "emea", 0, 0)}
    assert {tuple(r) for r in tokens.budget(tokens.segment_tokens(df)).collect()} == {("emea", "de", "emea", 2, n, 8), ("himl", "unknown", "unspecified", 1, 0, 0)}
    assert tokens.segment_tokens(df.limit(0)).count() == 0
