import gzip
import io
import json
import tarfile

import pytest

from weftline.schema import to_segments, validate
from weftline.sources import readers, writers

TMX = """<?xml version="1.0"?><tmx><body>
<tu><tuv xml:lang="de"><seg>Eine  Tablette
 täglich</seg></tuv><tuv xml:lang="en"><seg>One tablet a day</seg></tuv></tu>
<tu><tuv xml:lang="de"><seg>EU/1/96/022</seg></tuv><tuv xml:lang="en"><seg>EU/1/96/023</seg></tuv></tu>
<tu><tuv xml:lang="de"><seg>Gleich</seg></tuv><tuv xml:lang="en"><seg>gleich</seg></tuv></tu>
<tu><tuv xml:lang="de"><seg>Kurz</seg></tuv><tuv xml:lang="en"><seg>This is by far too long for it</seg></tuv></tu>
<tu><tuv xml:lang="de"><seg>Eine Tablette täglich</seg></tuv><tuv xml:lang="en"><seg>One tablet a day</seg></tuv></tu>
<tu><tuv xml:lang="de"><seg>Alt</seg></tuv><tuv xml:lang="de"><seg>Neu &amp; gut</seg></tuv><tuv xml:lang="de"><seg></seg></tuv><tuv xml:lang="en"><seg>New and good</seg></tuv></tu>
<tu><tuv xml:lang="de"><seg>Nur deutsch</seg></tuv></tu>
</body></tmx>"""


def test_tmx(spark, tmp_path):
    path = str(tmp_path / "a.tmx.gz")
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write(TMX)
    rows = readers.tmx_segments(spark, path).orderBy("id").collect()
    assert [(r.id, r.src_text, r.ref_text) for r in rows] == [
        ("emea-000001", "Eine Tablette täglich", "One tablet a day"),
        ("emea-000002", "EU/1/96/022", "EU/1/96/023"),
        ("emea-000003", "Neu & gut", "New and good"),
    ]
    assert readers.tmx_segments(spark, path, sample=2).count() == 2


def archive(tmp_path, broken=False):
    path = tmp_path / "t.tgz"
    with tarfile.open(path, "w:gz") as out:
        for subset in ("cochrane_output", "nhs_output"):
            for lang in ("en", "de"):
                ids = (1, 2, 10) if lang == "en" or not broken else (1, 3, 10)
                body = "".join(f'<seg id="{i}"> {lang} {subset}\n  {i} &amp; &quot;x&quot;</seg>' for i in ids).encode()
                info = tarfile.TarInfo(f"dir/{subset}.{lang}.sgm")
                info.size = len(body)
                out.addfile(info, io.BytesIO(body))
    return str(path)


def test_sgml_archive(spark, tmp_path):
    rows = readers.sgml_tar_segments(spark, archive(tmp_path), 2017).collect()
    assert [r.id for r in rows] == [f"himl2017-{s}-{i}" for s in ("cochrane", "nhs") for i in (1, 2, 10)]
    assert rows[0].src_text == 'en cochrane_output 1 & "x"'
    with pytest.raises(ValueError, match="one side only"):
        readers.sgml_tar_segments(spark, archive(tmp_path, True), 2017)
    with pytest.raises(Exception, match="no member ends"):
        readers.sgml_tar_segments(spark, archive(tmp_path), 2015).collect()


def test_reports(spark):
    rows = [
        (1, "German", "CT", " neck,chest", "Befund", "Finding", "J1", "C1", "Austria ", None),
        (2, " german ", None, None, "Leer", "  ", None, None, None, None),
        (3, "Turkish", " MR ", "x", "Bulgu", "Finding", None, None, None, None),
        (4, "French", "CT", "x", "a", "b", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "no long, language string, modality string, area string, report string, translation string, icd string, contributor_code string, country string, subspecialty string")
    (de,) = readers.report_segments(df).collect()
    assert (de.id, de.domain, de.src_text, de.ref_text, de.metadata["area"], de.metadata["subspecialty"]) == ("parrot-1", "parrot-ct", "Befund", "Finding", "neck, chest", "")
    (tr,) = readers.report_segments(df, "en", "tr").collect()
    assert (tr.src_text, tr.ref_text, tr.domain) == ("Finding", "Bulgu", "parrot-mr")
    with pytest.raises(ValueError):
        readers.report_segments(df, "de", "tr")


def test_rows_and_writers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"b": 1, "a": null}\n\n{"b": 2, "a": "ü"}\n', encoding="utf-8")
    df = readers.read_rows(spark, str(path))
    assert df.count() == 2
    writers.write_rows(df, str(tmp_path / "out"), str(tmp_path / "out.parquet"))
    lines = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("*.json"))).split("\n")
    assert '{"a":null,"b":1}' in lines
    assert readers.read_rows(spark, [str(path), str(tmp_path / "out.parquet")]).count() == 4
    (tmp_path / "a.csv").write_text('x,y\n"a ""q"", b\nc",2\n')
    assert readers.read_rows(spark, str(tmp_path / "a.csv")).first().x == 'a "q", b\nc'
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\n{"b": \n')
    with pytest.raises(Exception):
        readers.read_rows(spark, str(tmp_path / "bad.jsonl"), "b int").collect()
    with pytest.raises(ValueError, match="suffix"):
        readers.read_rows(spark, "a.txt")


def test_segments_from_aliases(spark):
    df = spark.createDataFrame([("s1", "", "Text", "Referenz", " EN", "Deutsch", "x")], "uid string, src_text string, source string, reference string, src_lang string, target_lang string, note string")
    (row,) = to_segments(df).collect()
    assert (row.id, row.src_text, row.ref_text, row.src_lang, row.tgt_lang, row.domain, row.metadata) == ("s1", "Text", "Referenz", "en", "de", "unspecified", {"note": "x"})
    (back,) = to_segments(df, reverse=True).collect()
    assert (back.src_lang, back.src_text, back.ref_text) == ("de", "Referenz", "Text")
    assert validate(to_segments(df)).count() == 1
    for bad, rule in (((None, None, "en", "de"), "missing source text"), (("a", "t", "en", "eng"), "equal languages"), (("a", "t", "fr", "de"), "unsupported source language")):
        rows = spark.createDataFrame([bad], "id string, src string, lang string, tgt_lang string")
        with pytest.raises(ValueError, match=rule):
            validate(to_segments(rows))
    with pytest.raises(ValueError, match="duplicate id"):
        validate(to_segments(df.union(df)))
    with pytest.raises(ValueError, match="no segments"):
        validate(to_segments(df.limit(0)))


def test_term_bank_and_curves(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "y"), ("a", "x", "y"), ("b", "x", None), ("c", "", "y")], "concept_id string, en string, de string")
    assert readers.term_bank(df) == [("a", "x", "y")]
    with pytest.raises(ValueError, match="needs"):
        readers.term_bank(df.drop("de"))
    (tmp_path / "c.csv").write_text("model,bleu\na,—\nb,1.5\n", encoding="utf-8")
    assert [r.bleu for r in readers.curve_table(spark, str(tmp_path / "c.csv")).collect()] == [None, "1.5"]
    (tmp_path / "rt_sys.jsonl").write_text(json.dumps({"step": 1}) + "\n")
    assert readers.run_folder(spark, str(tmp_path)).first().model == "sys"
