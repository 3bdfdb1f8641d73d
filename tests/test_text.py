from pyspark.sql import functions as F

import pytest

from weftline.functions import text


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column).collect()]


def test_sentences(spark):
    got = one(spark, text.sentences("t"), "Ein Knoten von 1.5 cm. Kein Erguss.", "A. iliaca frei! Ja? nein", "", None, "  x.\n y ")
    assert got == [["Ein Knoten von 1.5 cm.", "Kein Erguss."], ["A. iliaca frei!", "Ja?", "nein"], [], None, ["x.", "y"]]


def test_chunks_and_back(spark):
    docs = spark.createDataFrame([(0, ""), (1, "One a. Two b. Three c. " + "Long" * 20 + "."), (2, "Only one.")], "id int, t string")
    parts = text.chunk_documents(docs, "id", "t", 5)
    assert [tuple(r) for r in parts.filter("id = 1").orderBy("position").select("chunk", "n_chunks").collect()] == [("One a. Two b.", 3), ("Three c.", 3), ("Long" * 20 + ".", 3)]
    got = {r["id"]: r["text"] for r in text.reassemble(docs, parts, "id").collect()}
    assert got == {0: "", 1: "One a. Two b. Three c. " + "Long" * 20 + ".", 2: "Only one."}
    with pytest.raises(Exception, match="chunks are missing"):
        text.reassemble(docs, parts.filter("position <> 1"), "id").collect()


def test_strings(spark):
    assert one(spark, text.strip_thinking("t"), "<THINK>a\nb</think> x ", "<think>open") == ["x", "<think>open"]
    assert one(spark, text.unescape("t"), "A &amp; B &lt; C &gt; D &quot;q&quot; &amp;lt;") == ['A & B < C > D "q" &lt;']
    assert one(spark, text.area("t"), "  Head   and  Neck ", "abdomen,pelvis", "Abdomen , Pelvis ,", None, " ") == ["head and neck", "abdomen, pelvis", "abdomen, pelvis", "unspecified", "unspecified"]
    assert one(spark, text.same_model("t", F.lit("Vendor-V4-Flash")), "vendor/vendor-v4-flash-0731", "other/Vendor-V4-Pro") == [True, False]


def test_batches(spark):
    good, spaced, short, wrong, empty, plain = one(spark, text.parse_batch("t", 2), "[[1]]\na\n\n[[2]]\nb", "[[ 1 ]] a [[2]] b", "[[1]] a", "[[2]] a [[1]] b", "[[1]] a [[2]] ", "a b")
    assert (good, spaced, short, wrong, empty, plain) == (["a", "b"], ["a", "b"], None, None, None, None)
    df = spark.createDataFrame([(["x", "y"], "deu", "English")], "a array<string>, s string, t string")
    prompt, single = df.select(text.batch_prompt("a", "s", "t"), text.single_prompt(F.col("a")[0], "s", "t")).first()
    assert prompt.startswith("Translate each of the following 2 medical texts from German to English.") and prompt.endswith("[[1]]\nx\n\n[[2]]\ny")
    assert single.endswith("explanation.\n\nx")
