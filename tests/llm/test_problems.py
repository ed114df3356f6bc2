"""Training-data operators on small fixtures: odd input, ties, and brute force."""

import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from evalspan.llm import canonical_names, leakage, mixture, queries, reading_level, survivors
from evalspan.llm.words import words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    df.collect()
    assert df.columns


# Words


def test_words():
    assert words("<p>Stoic-\nhiometric &amp; CD3+ [12] ﬁne­ly</p>\nA_b 20.5") == ["stoichiometric", "cd3", "finely", "a", "b", "20", "5"]
    assert words("in-\nstrument -\n x-\n- y") == ["instrument", "x", "y"]
    assert words(None) == words("") == words(" \n-\n ") == []
    assert words("ГОСТ ñandú") == ["гост", "ñandú"]
    assert words("wo­\nrd") == ["word"]


# 1: survivors


def test_identifiers(spark):
    df = spark.createDataFrame([("OMIP-077", "PMCID: PMC0012", "https://doi.org/10.1/A.7."), ("omip77", "12", "DOI:10.1000/x-7"), ("OMIP-000", "n/a", "10.5555/tbd"), (None, "", None)], "o string, p string, d string")
    got = [tuple(r) for r in df.select(survivors.number_key(F.col("o"), "OMIP"), survivors.number_key(F.col("p"), "(?:PMCID)?(?:PMC)?"), survivors.doi_key(F.col("d"))).collect()]
    assert [g[:2] for g in got] == [("77", "12"), ("77", "12"), (None, None), (None, None)]
    assert got[1][2] == "1000/x7" and got[2][2] is None and got[3][2] is None


def groups_of(spark, rows):
    df = spark.createDataFrame(rows, "id long, a string, b string, node string")
    return {r.record_id: r.group for r in survivors.duplicate_groups(df, "id", {"a": F.col("a"), "b": F.col("b")}).collect()}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, str(rng.randrange(60))]), rng.choice([None, str(rng.randrange(60))]), "x") for i in range(150)]
    rows += [(1000 + i, str(2000 + i), str(2001 + i), None) for i in range(40)]  # a long chain
    rows += [(3000 + i, "hub", str(5000 + i), None) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a, b, _ in rows:
        for k in (("a", a), ("b", b)):
            if k[1] is not None:
                parent[find(k)] = find(i)
    least = {}
    for i, *_ in rows:
        least[find(i)] = min(i, least.get(find(i), i))
    # Chains link through equal values of the same name only.
    assert groups_of(spark, rows) == {i: least[find(i)] for i, *_ in rows}
    assert groups_of(spark, []) == {}


def brute_force(records, first, second):
    best = None
    for a in records:
        for b in records:
            if any(r["x"] == a["x"] and r["y"] == b["y"] for r in records):
                v = (a[first] + b[second], (a[first], -a["id"]), (b[second], -b["id"]))
                best = max(best or v, v)
    return best[0]


def test_branch_and_bound_maximises_trust(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice("pq"), rng.choice("uvw"), rng.random(), rng.random()) for g in range(20) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "g int, id int, x string, y string, s double, t double")
    b = [survivors.Bundle("a", {"x": F.col("x"), "s": F.col("s")}, [F.col("s"), -F.col("id")]), survivors.Bundle("b", {"y": F.col("y"), "t": F.col("t")}, [F.col("t"), -F.col("id")])]
    got = {r.group: r for r in survivors.best_representatives(df, "g", b, [survivors.Dependency("a", "x", "b", "y")]).collect()}
    for g in range(20):
        records = [dict(zip(("g", "id", "x", "y", "s", "t"), r)) for r in rows if r[0] == g]
        assert got[g].a.s + got[g].b.t == pytest.approx(brute_force(records, "s", "t"))
        assert any(r["x"] == got[g].a.x and r["y"] == got[g].b.y for r in records)
    free = {r.group: r for r in survivors.best_representatives(df, "g", b).collect()}
    assert all(free[g].a.s == max(r[4] for r in rows if r[0] == g) for g in range(20))


def test_no_group_is_lost_where_bundles_do_not_fit(spark):
    """The most complete choice wins, then the most trusted one; what is left out sets no condition."""
    rows = [
        (1, 1, "m", "p", None, 0.9), (1, 2, "n", None, "g", 0.5),  # no record has both: the more trusted bundle stays
        (2, 3, "m", None, "g", 0.5), (2, 4, "n", None, "h", 0.7),  # no candidate of the first bundle
        (3, 5, "m", None, None, 0.5),
        (None, 6, "m", "p", "g", 0.2), (None, 7, "n", "q", "h", 0.3),
        (4, 8, "m", "p", "g", 0.1), (4, 9, "n", "q", None, 0.9), (4, 10, "m", "r", None, 0.2),  # two bundles beat one of more trust
    ]
    df = spark.createDataFrame(rows, "g int, id int, m string, p string, q string, s double").withColumn("group", F.lit(1))
    b = [survivors.Bundle(n, {"v": F.col(c), "m": F.col("m")}, [F.col("s"), F.col("id")], F.col(c).isNotNull()) for n, c in (("a", "p"), ("b", "q"))]
    got = {r.group: (r.first_id, r.a and r.a.v, r.b and r.b.v) for r in survivors.best_representatives(df, "g", b, [survivors.Dependency("a", "m", "b", "m")], "id").collect()}
    assert got == {1: (1, "p", None), 2: (3, None, "h"), 3: (5, None, None), None: (6, "q", "h"), 4: (8, "r", "g")}


def test_candidates_are_met_by_rare_grams():
    """The pairs that a value meets grow with shared rare n-grams, not with the list."""
    rng = random.Random(4)
    stems = ["".join(rng.choice(string.ascii_lowercase) for _ in range(9)) for _ in range(2000)]
    weights = canonical_names.Weights()
    for s in stems:
        weights.add("l", s)
    index = canonical_names.NameIndex([("l", s, s, "") for s in stems], weights)
    met = [len(index.retrieved("l", s, "", 0.23)) for s in stems[:100]]
    assert all(index.scores("l", s, "", 0.23)[s] == pytest.approx(1) for s in stems[:100])
    assert sum(met) / len(met) < 0.5 * len(stems)
    every = {s: dict(weights.vector("l", s)) for s in stems}
    for s in stems[:20]:  # nothing that reaches the bound is lost
        length = lambda v: sum(w * w for w in v.values()) ** 0.5
        want = {t for t in stems if sum(w * w for g, w in every[s].items() if g in every[t]) / (length(every[s]) * length(every[t])) >= 0.23}
        assert set(index.scores("l", s, "", 0.23)) == want


def test_names_in_blocks(spark, monkeypatch):
    values = ["cd3", "granutideK", "Tarsoiln alpha", "BXV-605", "morphin"]
    one = mapped(spark, values)
    monkeypatch.setattr(canonical_names, "BLOCK_STEMS", 3)
    assert mapped(spark, values) == one


def test_survivors_without_usable_values(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 2, float("nan"), None), (2, 3, 0.1, "v")], "g int, id int, s double, v string")
    b = [survivors.Bundle("rec", {"id": F.col("id")}, [F.col("s"), F.col("id")]), survivors.Bundle("val", {"v": F.col("v")}, [F.col("s")], F.col("v").isNotNull())]
    got = {r.group: r for r in survivors.best_representatives(df, "g", b).collect()}
    assert got[1].rec.id == 2 and got[1].val is None and got[2].val.v == "v"
    assert survivors.best_representatives(df.filter("false"), "g", b).count() == 0


# 3: canonical names


def mapped(spark, values, names=("CD3", "CD45RA", "Tarsolin alpha", "Tarsolin beta", "Granutide A", "Granutide K", "Brillex Violet 421", "Brillex Violet 605", "PE", "PE-Cy7"), synonyms=(("BXV421", "Brillex Violet 421"), ("GrA", "Granutide A"))):
    n = spark.createDataFrame([("l", x) for x in names], "list string, name string")
    s = spark.createDataFrame(list(synonyms), "synonym string, canonical string")
    v = spark.createDataFrame([("l", x) for x in values], "list string, value string")
    return {r.value: r.canonical for r in canonical_names.canonical_values(v, n, s, queries.REAGENTS).collect()}


def test_canonical_values(spark):
    want = {
        "cd3": "CD3", "ＣＤ３": "CD3", "anti-human CD3": "CD3", "α-CD3": "CD3", "C.D.3": "CD3", "CD 45RA ;": "CD45RA", "CD45RO": "", "CD45": "", "CD31": "",
        "Tarsolin-α": "Tarsolin alpha", "Tarsoiln alpha": "Tarsolin alpha", "Tarsolin gamma": "", "Granutide B": "", "granutideK": "Granutide K", "GrA": "Granutide A", "gra": "Granutide A",
        "BXV-605": "Brillex Violet 605", "Brilelx Violet 421®": "Brillex Violet 421", "Brillex Violet (421)": "Brillex Violet 421", "Brillex Violet 999": "", "PE (conj.)": "PE", "PE Cy7 dye": "PE-Cy7",
        "CD3 (surface)": "CD3", "lot 3": "", "-": "", "?": "", "Quasardot": "", "x" * 3000: "",
    }
    assert mapped(spark, want) == want


def test_canonical_edges(spark):
    assert mapped(spark, ["cd3"], names=(), synonyms=()) == {"cd3": ""}
    assert mapped(spark, []) == {} and mapped(spark, [None, "", " \u00a0\t"]) == {}
    assert mapped(spark, ["morphin"], names=("morphina", "morphinb"), synonyms=()) == {"morphin": ""}  # two equally good names


# 6: leakage


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, x, "e") for i, x in enumerate(docs)], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(100 + i, x, 5) for i, x in enumerate(items)], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r.longest_run for r in leakage.find_leaks(d, t, **kw).collect()}


ITEM = "a donor of twenty one years gave a sample in which most events were memory cells and the rest was lost"


def test_leaks(spark):
    w = ITEM.split()
    part = " ".join(w[3:15])
    docs = [ITEM.upper(), f"x {part}. y", " ".join(w[3:14]), f"<p>{part.replace(' ', '  ')}</p>".replace("sample", "sam-\nple [3]"), None, "", " ".join(reversed(w)), ("filler " * 5000) + part, part]
    got = leaks(spark, docs, [ITEM, "short item", None, ITEM])
    assert {k for k, run in got.items() if run >= 12} == {(d, i) for d in (0, 1, 3, 7, 8) for i in (100, 103)}
    assert got[0, 100] == len(w) and got[8, 100] == 12
    assert leaks(spark, docs, []) == {} and leaks(spark, [], [ITEM]) == {}


def test_items_in_blocks(spark, monkeypatch):
    """Rows don't depend on the blocks of items: neither the words of a document nor the weights of shingles do."""
    w = ITEM.split()
    items = [ITEM, ITEM.replace("sample", "well known sample"), ITEM.replace("sample", "wellknown sample"), " ".join(reversed(w)), ITEM.replace("cells", "cell")]
    docs = [ITEM, ITEM.replace("sample", "well-\nknown sample"), ITEM.replace("donor", "person"), ITEM * 3, "nothing of it"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    t = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = {tuple(r) for r in leakage.find_leaks(d, t).collect()}
    assert {i for doc, i, *_, run in one if doc == 1 and run == len(w) + 1} == {2}
    for chars in (60, 250):
        monkeypatch.setattr(leakage, "BLOCK_CHARS", chars)
        assert {tuple(r) for r in leakage.find_leaks(d, t).collect()} == one
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 7)
    monkeypatch.setattr(leakage, "CHUNK_PAIRS", 3)
    assert {tuple(r) for r in leakage.find_leaks(d, t).collect()} == one


def index_of(texts):
    bags = [np.unique(leakage.shingle_hashes(leakage.word_hashes(words(x), leakage._Hashes()))) for x in texts]
    counts = np.zeros(1 << 16, np.uint32)
    for b in bags:
        counts[np.unique(leakage.ShingleTable.slots(b, 16))] += 1
    table = leakage.ShingleTable(counts, len(texts))
    return leakage.ItemIndex(list(range(len(texts))), texts, table), table


@settings(max_examples=25, deadline=None)
@given(hs.integers(0, 2**32))
def test_all_fingerprints_within_the_radius_are_found(seed):
    rng = np.random.default_rng(seed)
    index, _ = index_of([" ".join(rng.choice(list(string.ascii_lowercase), 40 + i % 3)) for i in range(30)])
    near = index.fps[rng.integers(0, len(index.fps), 60)]
    for _ in range(20):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)) * rng.integers(0, 2, len(near)).astype(np.uint64)
    size = int(index.sizes[1])
    i, j = index.within_radius(near, size)
    got = set(zip(i.tolist(), j.tolist()))
    assert got == {(a, b) for a in range(len(near)) for b in range(len(index.fps)) if index.size[b] == size and int(near[a] ^ index.fps[b]).bit_count() <= leakage.RADIUS}


# 7: mixture


def test_sainte_lague():
    assert mixture.sainte_lague([53, 24, 23], [99] * 3, 7) == [3, 2, 2]
    assert mixture.sainte_lague([0.5, 0.5], [1, 9], 4) == [1, 3]
    assert mixture.sainte_lague([0.0, 1.0], [5, 2], 9) == [0, 2] and mixture.sainte_lague([], [], 3) == []


def test_mixture_shares(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["cells", "gate", "panel", "dye", "marker"]) for _ in range(rng.randint(5, 60)))
    docs = [(i, "Big-Source" if i % 3 else " small ", text()) for i in range(600)] + [(900, None, "x y"), (901, "other", "z"), (902, "small", None), (903, "small", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big_source", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(d, t, blocks=500)
    got = {r.source: r for r in report.collect()}
    assert got["big_source"].actual_share == pytest.approx(4 / 9, abs=0.01) and got["small"].actual_share == pytest.approx(5 / 9, abs=0.01)
    assert got["absent"].actual_share == 0 and got["other"].chosen_tokens == 0 and None in got
    picked = {r.doc_id: r.repeats for r in chosen.collect()}
    assert all(1 <= n <= (1 if docs[i][1].startswith("Big") else 3) for i, n in picked.items() if i < 600) and not {900, 901, 902, 903} & set(picked)
    assert {r.doc_id: r.repeats for r in mixture.mix(d.repartition(5), t, blocks=500)[0].collect()} == picked
    assert mixture.mix(d.filter("false"), t)[0].count() == 0
    half = mixture.mix(d, t, total_tokens=1000, blocks=500)[1]
    assert half.agg(F.sum("chosen_tokens")).first()[0] == pytest.approx(1000, abs=80)


# 8: reading level


def test_reading_levels(spark):
    rng = random.Random(3)
    easy, hard = [f"cat{c}" for c in "abcdefgh"], [f"epistemological{c}" for c in "abcdefghijklmnop"]
    common = "the of and to a in that is on with".split()

    def text(level, n=90, stop="."):
        out, length = [], 8 if level == 1 else 30
        while n > 0:
            s = [rng.choice(common if k % 2 else (easy if level == 1 or rng.random() < 0.1 else hard)) for k in range(length)]
            out.append(" ".join(s).capitalize() + stop)
            n -= length
        return " ".join(out)

    docs = [(i, text(1 + i % 2)) for i in range(120)] + [(500, text(2, stop="")), (501, text(1).upper()), (502, "the cat is " * 10), (503, None), (504, ""), (505, "der die das und nicht ist mit ein eine den " * 12)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, level string")
    s = spark.createDataFrame([(1 + i % 2, text(1 + i % 2)) for i in range(20)] + [(None, "x"), (1, None)], "level int, text string")
    got = {r.doc_id: r for r in reading_level.reading_levels(d, s).collect()}
    assert all(got[i].level == 1 + i % 2 for i in range(120))
    assert got[500].level == 2 and got[500].sentence_length is None and got[501].level == 1
    assert not {502, 503, 504, 505} & set(got)
    assert reading_level.reading_levels(d.filter("false"), s).count() == 0
    with pytest.raises(ValueError):
        reading_level.reading_levels(d, s.filter("level = 1"))


def test_features_count_words_outside_each_list():
    f = reading_level.Features({"a": 1, "b": (1 << reading_level.N_LISTS) - 1})
    assert f(["a", "b", "c", "c"])[0] == 0.5 and f(["a", "b", "c", "c"])[1] == 0.75


def test_findings_have_the_given_columns(spark):
    want = {"p1_found": ["group_id", "survivor_id", "best_panel"], "p3_found": ["test_case_id", "ord", "field", "canonical"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "level"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns == columns


def test_tags_of_any_length_are_no_words():
    from evalspan.llm.words import words

    link = '<a href="https://example.org/' + "path/" * 100 + '" class="x">'
    assert words(f"one two {link}three</a> four") == ["one", "two", "three", "four"]
