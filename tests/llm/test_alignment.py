import random
import time

from weftline.llm import alignment as a

ORGANS = {"Leber": "liver", "Niere": "kidney", "Milz": "spleen", "Schulter": "shoulder", "Aorta": "aorta", "Lunge": "lung", "Herz": "heart"}
SIGNS = {"Zyste": "cyst", "Fraktur": "fracture", "Erguss": "effusion", "Stenose": "stenosis", "Nekrose": "necrosis", "Adenom": "adenoma"}


def line(rng):
    o, s, n = rng.choice(list(ORGANS)), rng.choice(list(SIGNS)), rng.randint(11, 99)
    return rng.choice(
        [
            (f"{s} in der {o}, {n},5 mm messend.", f"{SIGNS[s].capitalize()} of {n / 10 + 0.05:.2f} cm in the {ORGANS[o]}."),
            (f"Die {o} zeigt keine {s}.", f"No {SIGNS[s]} of the {ORGANS[o]} is noted."),
            (f"Seit {n % 28 + 1:02d}.03.20{n % 20 + 10} unverändert {s}.", f"Since 20{n % 20 + 10}-03-{n % 28 + 1:02d} the {SIGNS[s]} is unchanged."),
            ("Befund:", "Findings:"),
            ("Beurteilung:", "Impression:"),
        ]
    )


def documents(n, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        seen, pairs = set(), []
        while len(pairs) < rng.randint(3, 9):
            p = line(rng)
            if p[0] not in seen:
                seen.add(p[0])
                pairs.append(p)
        src, ref = [], []
        kinds = [rng.choice(["both", "both", "both", "both", "src", "ref"]) for _ in pairs]
        links, last = [], None
        for (s, r), kind in zip(pairs, kinds):
            if kind == "src":
                src.append(s)
                last = None
                continue
            if kind == "ref":
                ref.append(f"Translator's note {rng.randint(100, 999)}: illegible wording")
                last = None
                continue
            src.append(s)
            if last is not None and rng.random() < 0.15:
                ref[-1] += " " + r
            else:
                ref.append(r)
            last = len(ref)
            links.append((len(src), len(ref)))
        if not src or not ref or len(src) + len(ref) < 3:
            continue
        rows.append((f"d{i}", "\n".join(src), "\n".join(ref), "DE"))
        want[f"d{i}"] = set(links)
    return rows, want


def test_precision_and_recall_on_held_out_documents(spark):
    rows, want = documents(400, 5)
    extra = [rows[0], ("one", "Die Leber zeigt keine Zyste.", "No cyst of the liver is noted.", "de"), ("null", None, "x", "de"), ("empty", "a\nb", "", "de"), (None, "a\nb", "c", "de")]
    df = spark.createDataFrame(rows + extra, "id string, src_text string, ref_text string, src_lang string").selectExpr("*", "1 AS lang", "2 AS src", "3 AS n")
    got = {}
    for r in a.align_documents(df).collect():
        got.setdefault(r["id"], set()).add((r["src_line"], r["ref_line"]))
    assert set(got) <= set(want)
    hits = sum(len(got.get(k, set()) & v) for k, v in want.items())
    assert hits / sum(map(len, want.values())) > 0.95
    assert hits / sum(map(len, got.values())) > 0.95
    assert a.align_documents(df.limit(0)).count() == 0


def test_tokens():
    assert a.tokens("Am 05.03.2020: 1.200 mg, 12,0 cm; fünf") == ["am", "@2020-03-05", "#12", "mg", "cm", "#5"]
    assert a.tokens("2020-03-05 Findings:") == ["@2020-03-05", "findings:"]
    assert a.tokens("") == []


def test_moved_lines_pair_without_order():
    tables = a.Tables([("zyste", "cyst", 1.0), ("leber", "liver", 1.0), ("niere", "kidney", 1.0)], {}, 2.0)
    src = [a.tokens("Zyste Leber"), a.tokens("Zyste Niere")]
    ref = [a.tokens("kidney cyst"), a.tokens("liver cyst")]
    assert a.align(src, ref, tables) == [(0, 1), (1, 0)]
    assert a.align([], ref, tables) == [] and a.align(src, [[]], tables) == []


def test_tables_of_any_size_give_the_same(spark):
    rows, _ = documents(60, 9)
    df = spark.createDataFrame([*rows, rows[0]], "id string, src_text string, ref_text string, src_lang string")
    held, joined = ({tuple(r) for r in a.align_documents(df, most_entries=n).collect()} for n in (a.MOST_ENTRIES, 0))
    assert held == joined and len(held) > 100


def test_a_line_of_20000_words_takes_time_in_proportion(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(20_000)]
    long = (" ".join(words), " ".join(f"{w}x" for w in words))
    rows = [("long", f"Befund:\n{long[0]}", f"Findings:\n{long[1]}", "de"), ("long2", f"{long[0]}\nBefund:", f"{long[1]}\nFindings:", "de")]
    began = time.perf_counter()
    got = {tuple(r) for r in a.align_documents(spark.createDataFrame(rows, "id string, src_text string, ref_text string, src_lang string")).collect()}
    assert {("long", 2, 2), ("long2", 1, 1)} <= got and time.perf_counter() - began < 240


def test_many_lines_that_join_one_are_no_cubic_search():
    table = a.Tables([], {}, 1.0)
    src = [[f"#{k}{i}" for k in (7, 8)] for i in range(600)]
    ref = [[t for line in src[:300] for t in line], *src[300:]]
    began = time.perf_counter()
    got = a.align(src, ref, table)
    assert {(i, i - 299) for i in range(300, 600)} <= set(got) and sum(j == 0 for _, j in got) >= 1 and time.perf_counter() - began < 20
