import pytest

from weftline.operators import quantities as q

UNITS = q.units()


def read(text):
    return [(UNITS[u].token, d, k) for u, d, k in q.mentions(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Drink .5 dl", [("dl", 5, 1)]),
        ("size [mm] 72 * 56. 28 % x", [("mm", 72, 0), ("mm", 56, 0)]),
        ("A 97-mm nodule", [("mm", 97, 0)]),
        ("6 cm x 2.5 cm x 9,3 cm", [("cm", 6, 0), ("cm", 25, 1), ("cm", 93, 1)]),
        ("7,30 mal 11,70 Zentimeter", [("zentimeter", 730, 2), ("zentimeter", 1170, 2)]),
        ("1.000 Milligramm", [("milligramm", 1000, 0)]),
        ("boyut (CM): 1,93x2 a", [("cm", 193, 2), ("cm", 2, 0)]),
        ("Maße in mm: 28,8", [("mm", 288, 1)]),
        ("On iki mililitre", [("mililitre", 12, 0)]),
        ("twenty-five mm, two hundred and five ml", [("mm", 25, 0), ("ml", 205, 0)]),
        ("fünfundzwanzig mm, zweihundert ml, hundertelf mg", [("mm", 25, 0), ("ml", 200, 0), ("mg", 111, 0)]),
        ("iki yüz kırk beş mg", [("mg", 245, 0)]),
        ("five milligrams", [("milligrams", 5, 0)]),
        ("112ММ and ５ ｃｍ", [("mm", 112, 0), ("cm", 5, 0)]),
        ("5 mg/dl, 12 Wochen, 45 HU, 12.03.2015 entsorgen, C6/7", []),
        ("3-mal täglich 20 mg", [("mg", 20, 0)]),
        ("2,900-μm, 800µg", [("μm", 2900, 0), ("µg", 800, 0)]),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, want):
    assert read(text) == want


def test_numbers():
    assert [q.read_number(t) for t in ("1,234,567", "1.234,5", "0,05", ".125", "12", "zwölf", "3.50")] == [(1234567, 0), (12345, 1), (5, 2), (125, 3), (12, 0), (12, 0), (350, 2)]


def test_numbers_beyond_64_bits_keep_their_size():
    assert q.read_number("4" + "0" * 29) == (4 * 10**17, -12)
    assert q.read_number("0." + "0" * 29 + "12") == (12, 31)
    assert q.read_number("1.5" + "0" * 40) == (15 * 10**16, 17)


def edge(a, b, power, n=50, share=0.95):
    number = {u.token: i for i, u in enumerate(UNITS)}
    (sa, ua), (sb, ub) = a.split("/"), b.split("/")
    return q.Edge(q.Node(sa, number[ua]), q.Node(sb, number[ub]), n, share, power, 0.0)


def named(scales):
    return {f"{node.source}/{UNITS[node.unit].token}": exponent for node, (exponent, _) in scales.items()}


def test_scales_come_from_links_and_wrong_links_do_not_spoil_them():
    scales = q.unit_scales([edge("s/mm", "m/cm", -1), edge("s/mm", "n/zentimeter", -1), edge("s/ml", "m/cl", 3), edge("s/mg", "m/mm", 2)])
    assert named(scales) == {"s/mm": 3, "m/cm": 4, "n/zentimeter": 4, "s/ml": 3, "m/cl": 4}
    confirmed = {f"{node.source}/{UNITS[node.unit].token}": sure for node, (_, sure) in scales.items()}
    assert confirmed["m/cm"] and not confirmed["m/cl"]  # one edge against the spelling is no proof


def test_a_source_that_writes_another_unit_than_it_means_is_put_right_by_the_graph():
    """Source x writes mg and g, but its numbers are those of micrograms and milligrams."""
    models = "abcd"
    links = [edge("x/mg", f"{m}/mg", -3) for m in models] + [edge("x/g", f"{m}/mg", 0) for m in models]
    links += [edge("y/mg", f"{m}/mg", 0, n=20) for m in models] + [edge("y/g", f"{m}/mg", 3, n=20) for m in models]
    assert named(q.unit_scales(links)) == {"x/mg": 0, "x/g": 3, "y/mg": 3, "y/g": 6, **{f"{m}/mg": 3 for m in models}}


def test_one_edge_decides_where_the_spelling_names_no_prefix():
    assert named(q.unit_scales([edge("s/gr", "m/mg", 0)])) == {"s/gr": 3, "m/mg": 3}
    assert named(q.unit_scales([edge("s/g", "m/mg", 0)])) == {"s/g": 6, "m/mg": 3}


def test_a_planted_source_changes_values_and_no_number_stops_the_job(spark):
    segments = [(f"x{i}", "lab", f"Dosis {i} mg", f"dose {i} µg") for i in range(1, 30)] + [(f"y{i}", "ward", f"Dosis {i} mg", f"dose {i * 1000} µg") for i in range(1, 30)]
    segments += [("big", "ward", "4000000000000000000 l", "1" + "0" * 40 + " mm and 0." + "0" * 30 + "1 mm")]
    evaluations = [(f"e{m}{k}{i}", f"{k}{i}", m, f"dose {i if k == 'x' else i * 1000} µg") for i in range(1, 30) for k in "xy" for m in ("a", "b")]
    s = spark.createDataFrame(segments, "id string, source string, src_text string, ref_text string")
    e = spark.createDataFrame(evaluations, "eval_id string, id string, model string, hyp_text string")
    got = {tuple(r) for r in q.quantities(s, e).collect()}
    assert {v for f, k, d, v in got if f == "src_text" and k == "x7"} == {7}  # as linked, not as spelled
    assert {v for f, k, d, v in got if f == "src_text" and k == "y7"} == {7000}
    assert {(f, v) for f, k, d, v in got if k == "big"} == {("src_text", None), ("ref_text", None), ("ref_text", 0)}


def test_tables(spark):
    segments = [(f"s{i}", f"Knoten {i} mm", f"Nodule {i / 10} cm") for i in range(1, 30)] + [("n", None, ""), ("s1", "Knoten 1 mm", "Nodule 0.1 cm"), (None, "5 mm", None)]
    evaluations = [(f"e{i}", f"s{i}", f"A nodule of {i * 1000} µm") for i in range(1, 30)] + [("e30", "s9", "cut 5 m"), (None, "s1", "7 mm")]
    s = spark.createDataFrame(segments, "id string, src_text string, ref_text string").selectExpr("*", "1 AS units", "2 AS field")
    e = spark.createDataFrame(evaluations, "eval_id string, id string, hyp_text string")
    graph = q.learned_graph(q.read_all(s, e))
    assert {(UNITS[x.a.unit].token, UNITS[x.b.unit].token, x.power) for x in graph if x.share > 0.9 and x.n > 20} == {("mm", "cm", -1), ("mm", "µm", 3)}
    gone = spark.createDataFrame([("e30",)], "eval_id string")
    got = {tuple(r) for r in q.quantities(s, e, gone).collect()}
    want = {(f, k, "length", i * 1000) for i in range(1, 30) for f, k in (("src_text", f"s{i}"), ("ref_text", f"s{i}"), ("hyp_text", f"e{i}"))}
    assert got == want
    assert ("hyp_text", "e30", "length", 5_000_000) in {tuple(r) for r in q.quantities(s, e).collect()}
    assert q.quantities(s.limit(0), e.limit(0)).count() == 0


def test_trusted_links_decide_against_the_spelling(spark):
    """Here 'gm' is written for milligrams throughout, as links with mg and µg both show; for dl one pair alone is off."""
    segments = [(f"a{i}", f"Dosis {i} gm", f"dose {i} mg") for i in range(1, 30)] + [(f"b{i}", f"Dosis {i} mg", None) for i in range(1, 30)]
    segments += [(f"c{i}", f"Menge {i} dl", f"volume {i * 10} ml") for i in range(1, 30)]
    evaluations = [(f"e{k}{i}", f"{k}{i}", f"dose {i * 1000} µg") for i in range(1, 30) for k in "ab"]
    s = spark.createDataFrame(segments, "id string, src_text string, ref_text string")
    e = spark.createDataFrame(evaluations, "eval_id string, id string, hyp_text string")
    got = {tuple(r) for r in q.quantities(s, e).collect()}
    for i in range(1, 30):
        assert {v for f, k, d, v in got if k in (f"a{i}", f"b{i}", f"ea{i}", f"eb{i}")} == {i * 1000}
        assert ("src_text", f"c{i}", "volume", i * 100_000) in got
