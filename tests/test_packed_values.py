import pytest

from millrace.operators import packed_values as P

NAMES = ["Lumen; Arc Collective", "Unknown", "Hale, Morrow & Finch", "Studio 5/7", "North|South Press"]
MODEL = P.Model({"WW": 100.0, "W,W": 100.0, "W": 5.0, "WW,S": 30.0, "W,W,Y": 30.0, "WWP": 20.0}, 0.5)


@pytest.mark.parametrize(
    ("field", "values"),
    [
        ("Otto Bra", ["Otto Bra"]),
        ("   ", []),
        ("Bra, Otto", ["Bra, Otto"]),
        ("Otto Bra, Ida Cro", ["Otto Bra", "Ida Cro"]),
        ("Otto Bra,Ida Cro and Max Dru", ["Otto Bra", "Ida Cro", "Max Dru"]),
        ("Bra, Otto, 1800-1871; Ida Cro", ["Bra, Otto, 1800-1871", "Ida Cro"]),
        ("Otto Bra, Jr.; Cro, Ida", ["Otto Bra, Jr.", "Cro, Ida"]),
        ("Lumen; Arc Collective; Otto Bra", ["Lumen; Arc Collective", "Otto Bra"]),
        ("Otto Bra, Hale, Morrow & Finch, Ida Cro", ["Otto Bra", "Hale, Morrow & Finch", "Ida Cro"]),
        ("Studio 5/7 / Otto Bra", ["Studio 5/7", "Otto Bra"]),
        ("Workshop of Studio 5/7", ["Workshop of Studio 5/7"]),
        ('"Otto ""Bob"" Bra", "Cro; Ida"', ['Otto "Bob" Bra', "Cro; Ida"]),
        ('["a \\"q\\" b", "Cro, Ida"]', ['a "q" b', "Cro, Ida"]),
        ("'Tobin O'Moru', 'Ida Cro'", ["Tobin O'Moru", "Ida Cro"]),
        ('Otto "Bob" Bra | Ida Cro', ['Otto "Bob" Bra', "Ida Cro"]),
        ("“Bra, Otto”; “Ida Cro”", ["Bra, Otto", "Ida Cro"]),
        ("Otto Bra (b. 1700; d. 1755); Ida Cro", ["Otto Bra (b. 1700; d. 1755)", "Ida Cro"]),
        ("(Otto Bra; Ida Cro)", ["Otto Bra", "Ida Cro"]),
        ("Otto Bra;;Ida Cro; ;", ["Otto Bra", "Ida Cro"]),
        ("Otto Bra\r\nIda Cro\n", ["Otto Bra", "Ida Cro"]),
        ("Otto Bra; Otto Bra", ["Otto Bra", "Otto Bra"]),
        (";,;", []),
        ('"unclosed; Otto Bra', ['"unclosed', "Otto Bra"]),
        ("Unknown, Ida Cro", ["Unknown", "Ida Cro"]),
    ],
)
def test_fields(field, values):
    assert P.split_field(field, P.lattice_of(NAMES), MODEL) == values


def test_hostile_fields_end():
    lattice = P.lattice_of(NAMES)
    for field in ("(" * 5000, "(a;" * 2000, ")" * 5000, '"' * 3001, "x, " * 5000, "[" * 60 + "a" + "]" * 60, "word " * 20_000, "“a; " * 5000, "(" * 20_000 + ")" * 20_000):
        assert isinstance(P.split_field(field, lattice, MODEL), list)


def _splits(run):
    import itertools

    n = len(run.bounds) // 2
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), r) for r in range(n)):
        yield [(a, b - 1) for a, b in itertools.pairwise([0, *cuts, n])]


def test_splits_and_chances_equal_all_segmentations():
    import math

    run = P.lattice_of([]).runs("Otto Bra, Jr., Ida Cro, Max")[0]
    score = lambda parts: sum(MODEL.value(run.span(*p)) for p in parts) + MODEL.follows * (len(parts) - 1)
    allowed = [s for s in _splits(run) if all(j - i <= MODEL.reach for i, j in s)]
    best = max(allowed, key=score)
    assert P.split_run(run, MODEL) == [run.span(*p) for p in best]
    total = sum(math.exp(score(s)) for s in allowed)
    for _, i, j, p in P.chances(len(run.bounds) // 2, MODEL.spans(run.shape), MODEL.follows):
        assert p == pytest.approx(sum(math.exp(score(s)) for s in allowed if (i, j) in s) / total, rel=1e-6)


def test_a_name_that_stands_only_in_lists_gains_frequency(spark):
    """`Kite, Loom` never stands alone or in quote marks; lists with other marks around it teach it, and it then stays whole in a list of commas."""
    plain = [f"Giv{chr(97 + i % 26)} Sur{chr(97 + i // 26)}" for i in range(520)]
    rows = plain[:400] + [f"{plain[i]}; Kite, Loom; {plain[i + 7]}" for i in range(200)] + [f"{plain[i]}, {plain[i + 3]}" for i in range(150)]
    lattice = P.lattice_of([])
    model = P.learn(spark.createDataFrame([(r,) for r in rows], "field string"), lattice)
    without = P.Model({f: n for f, n in model.forms.items() if f != "W,W"}, 0.5, None, {"W": 1200.0}, model.total)
    field = "Giva Sura, Kite, Loom, Givb Surb"
    assert model.whole("Kite, Loom") > -1e9 and without.whole("Kite, Loom") < -1e9
    assert P.split_field(field, lattice, model) == ["Giva Sura", "Kite, Loom", "Givb Surb"]
    assert P.split_field(field, lattice, without) == ["Giva Sura", "Kite", "Loom", "Givb Surb"]


def test_values_of_any_length_can_be_whole(spark):
    long = ", ".join(f"Part{chr(97 + i)}" for i in range(12))
    rows = [f'"{long}"; Giv Sur{chr(97 + i)}' for i in range(26)] + [f"Giv Sur{chr(97 + i)}" for i in range(26)]
    lattice = P.lattice_of([])
    model = P.learn(spark.createDataFrame([(r,) for r in rows], "field string"), lattice)
    assert P.split_field(f"Giv Sura; {long}", lattice, model) == ["Giv Sura", long]


def test_many_values_do_not_look_frequent_by_chance():
    import numpy as np

    rng = np.random.default_rng(1)
    crowded = P.Model({"WW": 1e6}, 0.5, rng.poisson(8.0, P.DEPTH * P.WIDTH), {"W": 2e6}, 1e6)
    assert sum(crowded.whole(f"Name {i}") > -1e9 for i in range(20_000)) <= 2


@pytest.mark.parametrize("held", [1 << 18, 100])
def test_all_frequent_values_stay_whole_however_many(spark, held):
    """400 names, each in quote marks in four fields, among so many single words that their form alone would be split."""
    letter = [chr(97 + i) for i in range(26)]
    names = [f"Kite{letter[i % 26]} & Loom{letter[i // 26]}" for i in range(400)]
    plain = [f"Giv{letter[i % 26]} Sur{letter[i // 26]}" for i in range(400)]
    lists = [f"{plain[i]} & {names[i]}" for i in range(400)]
    rows = lists + [f'"{names[i]}"; {plain[(i * 4 + k) % 400]}' for i in range(400) for k in range(4)]
    rows += [f"One{letter[i % 26]}{letter[i // 26 % 26]}{letter[i // 676]}" for i in range(8000)]
    df = spark.createDataFrame(list(enumerate(rows)), "meta_row long, creator string")
    got = {}
    for r in P.split_values(df, "creator", keep=["meta_row"], held=held).where("meta_row < 400").collect():
        got.setdefault(r["meta_row"], {})[r["pos"]] = r["value"]
    assert got == {i: {0: plain[i], 1: names[i]} for i in range(400)}


def test_a_long_value_is_whole_however_rare_its_form(spark):
    long = "Parta, Partb, Partc, Partd, Parte, Partf"
    letter = [chr(97 + i) for i in range(26)]
    rows = [f'"{long}"; Giv Sur{c}' for c in letter[:4]] + [f"Giv{a} Sur{b}{c}" for a in letter for b in letter for c in letter[:5]]
    lattice = P.lattice_of([])
    model = P.learn(spark.createDataFrame([(r,) for r in rows], "field string"), lattice)
    assert P.split_field(f"Giv Sura; {long}", lattice, model) == ["Giv Sura", long]


def test_listed_names_by_first_word():
    lattice = P.lattice_of(["Hale", "Hale, Morrow", "Hale, Morrow & Finch", "½ Co"])
    texts = lambda f: [v for r in lattice.runs(f) for v in P.split_run(r, MODEL)]
    assert texts("Hale, Morrow & Finch, Ida Cro") == ["Hale, Morrow & Finch", "Ida Cro"]
    assert texts("Hale, Morrow") == ["Hale, Morrow"] and texts("Hale, Otto Bra") == ["Hale", "Otto Bra"]
    assert texts("Hales, Otto Bra") != ["Hale", "Otto Bra"] and texts("½ Co; Otto Bra") == ["½ Co", "Otto Bra"]


def test_brackets_at_any_depth():
    assert P.split_field("[" * 70 + "Otto Bra; Ida Cro" + "]" * 70 + "; Max Dru", P.lattice_of([]), MODEL) == ["Otto Bra", "Ida Cro", "Max Dru"]


def test_learns_from_the_column(spark):
    rows = [(i, f"Sur{chr(97 + i % 26)}, Giv{chr(97 + i % 7)}") for i in range(60)]
    rows += [(100 + i, f"Giv{chr(97 + i % 7)} Sur{chr(97 + i % 26)}") for i in range(60)]
    rows += [(200, "Giva Surb, Givc Surd"), (201, None), (202, " 　"), (203, ""), (204, "Hale, Morrow & Finch"), (204, "Hale, Morrow & Finch"), (205, "Sura, Giva; Surb, Givb")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "meta_row long, creator string, value string, pos int")
    authority = spark.createDataFrame([(n,) for n in [*NAMES, None]], "creator_name string")
    got = {}
    for r in P.split_values(df, "creator", authority, keep=["meta_row"]).collect():
        got.setdefault(r["meta_row"], []).append((r["pos"], r["value"]))
    assert sorted(got[200]) == [(0, "Giva Surb"), (1, "Givc Surd")]
    assert sorted(got[205]) == [(0, "Sura, Giva"), (1, "Surb, Givb")]
    assert got[204] == [(0, "Hale, Morrow & Finch")] * 2
    assert not {201, 202, 203} & set(got)
    assert sorted(got[0]) == [(0, "Sura, Giva")]


def test_empty_table_and_no_authority(spark):
    df = spark.createDataFrame([], "meta_row long, creator string")
    out = P.split_values(df, "creator", None)
    assert out.columns == ["meta_row", "creator", "pos", "value"]
    assert out.count() == 0
