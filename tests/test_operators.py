import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import media, spoken, visual
from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import columns as P
from millrace.operators import filters as Fi
from millrace.operators import joins as J
from millrace.operators import lineage as L
from millrace.operators import records as R
from millrace.operators import sampling as S
from millrace.operators import sets as U
from millrace.operators import speech as Sp
from millrace.operators import windows as Wn


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_nested_extraction(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "x"}, "n": 3}'), (2, '{"a": {"b": "  "}}'), (3, None), (4, "no json")], "id int, j string")
    assert rows(P.extract_nested(df, "j", [("$.a.b", "b"), ("$.n", "n")]), "id") == [(1, "x", "3"), (2, None, None), (3, None, None), (4, None, None)]
    several = spark.createDataFrame([('{"a": [{"b": "x"}, {"b": "y"}]}',)], "j string")
    with pytest.raises(Exception, match="several values"):
        P.extract_nested(several, "j", [("$.a[*].b", "b")]).collect()
    one = spark.createDataFrame([('{"a": [{"b": "x"}]}',)], "j string")
    assert rows(P.extract_nested(one, "j", [("$.a[*].b", "b")])) == [("x",)]


def test_casting_errors_and_drops(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert rows(P.cast_columns(df, {"a": "int", "b": None})) == [(1,)]
    with pytest.raises(Exception):
        P.cast_columns(df, {"b": "int"}).collect()


def test_row_index_counts_from_zero_in_each_split(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(50)], "id long, split string")
    got = rows(P.assign_row_index(df, ["id"], "split"), "split", "id")
    for split in ("a", None):
        assert [r[2] for r in got if r[1] == split] == list(range(sum(1 for r in got if r[1] == split)))
    assert P.assign_row_index(df.limit(0), ["id"]).count() == 0


def test_null_outputs_filter_only_outputs(spark):
    df = spark.createDataFrame([(1, 10, None), (2, None, "s"), (None, 30, None)], "a int, b int, speaker string")
    got = P.map_columns(df, {"total": F.col("a") + F.col("b")}, filter_null_outputs=True)
    assert rows(got) == [(1, 10, None, 11)]


def test_override_rules_see_earlier_ones_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "y")], "x string, y string")
    got = P.override_values(df, [("x", "a", "y", "1"), ("y", "1", "x", "A"), ("y", None, "x", "never")])
    assert rows(got, "x") == [("A", "1"), ("b", "y")]


def test_composite_id_writes_none(spark):
    df = spark.createDataFrame([("d", None, 3)], "a string, b string, c int")
    assert rows(P.composite_id(df, ["a", "b", "c"]).select("id")) == [("d:None:3",)]


def test_caption_doesnt_fall_through_in_lists(spark):
    df = spark.createDataFrame([(["  ", "ab", "long enough"], "title text"), (None, " t "), (["long enough"], None)], "captions array<string>, title string")
    got = rows(P.select_caption(df, ["captions", "title"], min_characters=5).select("caption", "caption_source"))
    assert got == [("title text", "title"), (None, None), ("long enough", "captions")]


def test_matching_strips_unicode_white_space_and_keeps_nulls_on_request(spark):
    df = spark.createDataFrame([(" CC0 ",), ("cc0 1.0",), (None,), ("",)], "v string")
    assert rows(Fi.prune_matching(df, ["v"], ["cc0"])) == [(" CC0 ",)]
    assert len(rows(Fi.prune_matching(df, ["v"], ["cc0"], containing=True))) == 2
    assert len(rows(Fi.prune_matching(df, ["v"], ["cc0"], negate=True, prune_nulls=False))) == 3
    assert rows(Fi.prune_matching(df, ["v"], [])) == []


def test_range_is_exclusive_and_complemented(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)] + [(None,)], "v double")
    assert rows(Fi.prune_range(df, ["v"], 1, 3), "v") == [(2.0,)]
    assert rows(Fi.prune_range(df, ["v"], 1, 3, negate=True), "v") == [(0.0,), (1.0,), (3.0,), (4.0,)]
    assert len(rows(Fi.prune_range(df, ["v"], 1, 3, prune_nulls=False))) == 2


def test_any_all(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", None)], "x string, y string")
    assert len(rows(Fi.prune_matching(df, ["x", "y"], ["a"]))) == 2
    assert len(rows(Fi.prune_matching(df, ["x", "y"], ["a"], behavior="all"))) == 1
    with pytest.raises(ValueError):
        Fi.prune_matching(df, ["x"], ["a"], behavior="most")


def test_allow_list(spark):
    df = spark.createDataFrame([(1, "u", "v"), (2, "u", "w"), (3, "u", None), (4, None, "w")], "id int, a string, b string")
    allowed = spark.createDataFrame([("u",), ("v",), ("v",), (None,)], "url string")
    assert rows(Fi.prune_listed(df, ["a", "b"], allowed).select("id")) == [(1,)]
    assert rows(Fi.prune_listed(df, ["a", "b"], allowed, prune_nulls=False).select("id"), "id") == [(1,), (3,)]


def test_samples_are_nested(spark):
    df = spark.range(5000).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("id"))
    small, large = ({r[0] for r in Fi.sample_fraction(df, "id", f).collect()} for f in (0.1, 0.3))
    assert small < large and 400 < len(small) < 600


def test_opt_out_headers(spark):
    df = spark.createDataFrame([(1, {"X-Robots-Tag": "index, NoAI"}), (2, {"tdm-reservation": "1"}), (3, {"a": "b"}), (4, None)], "id int, h map<string,string>")
    assert rows(Fi.prune_opted_out(df, "h").select("id"), "id") == [(3,), (4,)]


def test_audio_quality(spark):
    import math

    tone = [0.3 * math.sin(i / 5) * (1 if (i // 1600) % 2 else 0.001) for i in range(16000)]
    df = spark.createDataFrame([(1, tone), (2, [0.0] * 16000), (3, [0.1] * 10), (4, None)], "id int, w array<double>")
    assert rows(Fi.prune_audio_quality(df, "w", 16000).select("id"), "id") == [(1,), (3,)]


def test_lookup_join(spark):
    left = spark.createDataFrame([(3, 9), (1, 9), (99, 9), (None, 9)], "k int, license int")
    right = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0), (None, "n", 0)], "k int, caption string, license int")
    got = {(r["k"], r["license"], r["caption"]) for r in J.join_lookup(left, right, "k", ["caption", "license"]).collect()}
    assert got == {(3, 9, "c"), (1, 9, "a"), (99, 9, None), (None, 9, "n")}
    with pytest.raises(Exception, match="unique"):
        J.join_lookup(left, right.union(right), "k", ["caption"]).collect()


def test_index_join(spark):
    source = spark.createDataFrame([(i, c, f"t{i}") for i, c in enumerate("abcd")], "row long, id string, text string")
    index = spark.createDataFrame([(2, "c", "I"), (0, "a", "J"), (0, "a", "K")], "row long, id string, text string")
    assert sorted(rows(J.join_index(index, source).select("id", "text"))) == [("a", "t0"), ("a", "t0"), ("c", "t2")]
    assert sorted(r[1] for r in rows(J.join_index(index, source, index_wins=True).select("id", "text"))) == ["I", "J", "K"]
    wrong = spark.createDataFrame([(1, "zz", "q")], "row long, id string, text string")
    with pytest.raises(Exception, match="disagree"):
        J.join_index(wrong, source).collect()


def test_first_occurrence_and_null_keys(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("x", 1, None), ("x", 2, "z")], "id string, ord int, v string")
    assert sorted(rows(Wn.first_occurrence(df, "id", ["ord"])), key=str) == sorted([(None, 1, "a"), ("x", 1, None)], key=str)


def test_sandwich_repair_is_sequential(spark):
    df = spark.createDataFrame([("d", i, s, 0) for i, s in enumerate("ABABB")], "docket string, turn int, speaker string, section int")
    assert "".join(r[0] for r in rows(Wn.repair_sandwiched(df, ["docket"], "turn", "speaker", "section").orderBy("turn").select("repaired"))) == "AAABB"


def test_fraction_split(spark):
    got = Wn.split_fractions(spark.range(4).withColumnRenamed("id", "n"), {"train": 0.75, "validation": 0.25}, ["n"])
    assert rows(got, "n") == [(0, "train"), (1, "train"), (2, "train"), (3, "validation")]


def test_weighted_frequency(spark):
    f = spark.createDataFrame([("a", "ONLY A", 2), ("a", "SHARED", 1), ("b", "ONLY B", 3), ("b", "SHARED", 1)], "source string, text string, n long")
    sizes = spark.createDataFrame([("a", 1.0, 100.0), ("b", 1.0, 300.0)], "source string, weight double, size double")
    assert rows(A.weighted_frequency(f, A.mixture_factors(sizes)), "text") == [("ONLY A", 6), ("ONLY B", 3), ("SHARED", 4)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(0, "p2"), (0, "p1"), (1, "p3"), (1, "p1"), (1, None), (1, ""), (1, "0")], "s int, v string")
    ids = A.dense_ids(df, "s", "v", F.lit("vctk"))
    assert rows(ids, "id") == [("vctk:p1", 0), ("vctk:p2", 1), ("vctk:0", 2), ("vctk:p3", 3)]
    assert A.is_dense(ids) and not A.is_dense(ids.where("id > 0"))


def test_error_rates(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat on", "a"), ("", "x", "b"), (None, None, "b")], "h string, r string, g string")
    counts = A.error_counts(df, "h", "r")
    assert rows(counts.select("word_edits", "words", "char_edits", "chars")) == [(1, 4, 3, 14), (1, 1, 1, 1), (0, 0, 0, 0)]
    overall = A.error_rates(counts, ["g"]).where("overall").first()
    assert overall["wer"] == pytest.approx(2 / 5)


def test_text_functions(spark):
    df = spark.createDataFrame([("Tom &amp; <b>Ann</b>  x",), ("  ",), (None,), ("<p></p>",)], "t string")
    assert rows(df.select(X.clean_text(F.col("t")))) == [("Tom & Ann x",), (None,), (None,), (None,)]
    terms = spark.createDataFrame([("A HUMAN skull",), ("humanity",), ("café!",), ("x™ y",), (None,)], "t string")
    assert [r[0] for r in rows(terms.select(X.matches_terms([F.col("t")], ["Human", "CAFÉ", "™"])))] == [True, False, True, False, False]
    ends = spark.createDataFrame([("end.",), ("Mr.",), ("J.",), ('yes?"',), ("no",), (None,)], "t string")
    assert [r[0] for r in rows(ends.select(X.ends_sentence(F.col("t"))))] == [True, False, False, True, False, False]
    roman = spark.createDataFrame([("XIV",), ("IX",), ("iii",), ("abc",), (None,)], "t string")
    assert [r[0] for r in rows(roman.select(X.roman_value(F.col("t"))))] == [14, 9, 3, None, None]


@pytest.mark.parametrize(
    ("token", "before", "usual"),
    [("24-316", None, "TWENTY FOUR THREE HUNDRED SIXTEEN"), ("1905", None, "NINETEEN OH FIVE"), ("$2,500", None, "TWO THOUSAND FIVE HUNDRED DOLLARS"), ("21st", None, "TWENTY FIRST"), ("II", "War", "TWO"), ("Mr.", None, "MISTER"), ("3.14", None, "THREE POINT ONE FOUR"), ("café", None, "CAFE"), ("50%", None, "FIFTY PERCENT"), ("--", None, "")],
)
def test_spoken(token, before, usual):
    assert " ".join(spoken.readings(token, before)[0]) == usual


def test_cardinals_round_trip():
    assert spoken.cardinal(10**11 + 5) == "ONE HUNDRED BILLION FIVE"
    assert spoken.cardinal(-21) == "MINUS TWENTY ONE" and spoken.ordinal(40) == "FORTIETH" and spoken.ordinal(12) == "TWELFTH"
    assert spoken.governor(["ARTICLES", "I,", "II", "AND", "III"], 4) == ("ARTICLES", True)
    assert all(spoken.cardinal(n) == spoken.cardinal(n // 1000) + " THOUSAND" + (" " + spoken.cardinal(n % 1000) if n % 1000 else "") for n in range(1000, 200_000, 777))
    assert spoken.cardinal(10**12 + 3) == "ONE THOUSAND BILLION THREE" and spoken.cardinal(0) == "ZERO"
    assert [spoken.numeral_value(x) for x in ("I", "IV", "IX", "XIV", "XXXVIII")] == [1, 4, 9, 14, 38]


@pytest.mark.parametrize(
    ("token", "before", "all_readings"),
    [("v.", None, ["VERSUS", "V"]), ("(c)(1)(v)", None, ["C ONE V"]), ("III's", "Article", ["THREE'S"]), ("II(2)", "Article", ["TWO TWO"]), ("VIII", "Henry", ["EIGHT", "THE EIGHTH"]), ("X", "Brand", ["X"]), ("I", "And", ["I"]), ("316", None, ["THREE HUNDRED SIXTEEN", "THREE SIXTEEN", "THREE ONE SIX"]), ("2500", None, ["TWO THOUSAND FIVE HUNDRED", "TWENTY FIVE HUNDRED", "TWO FIVE ZERO ZERO"])],
)
def test_all_readings(token, before, all_readings):
    assert [" ".join(r) for r in spoken.readings(token, before)] == all_readings


@pytest.mark.parametrize(
    ("text", "last"),
    [("Schedule I or II goods", ["ONE", "OR", "TWO", "GOODS"]), ("Schedule I, II; and IV", ["ONE", "TWO", "AND", "FOUR"]), ("World War I and II", ["ONE", "AND", "TWO"]), ("Henry VIII and IX", ["EIGHT/THE EIGHTH", "AND", "NINE/THE NINTH"]), ("Article III and I say", ["THREE", "AND", "I/ONE", "SAY"]), ("they and I", ["AND", "I"]), ("Title VII, and a", ["SEVEN", "AND", "A"])],
)
def test_numerals_keep_their_governor(text, last):
    got = ["/".join(" ".join(r) for r in t) for t in spoken.spoken_tokens(text.split())]
    assert got[-len(last) :] == last


def test_visual_text(spark):
    rules = visual.VisualText(["red", "gold", "vase", "pattern", "square", "green", "glass", "lamp", "stripes", "flat", "base"], ["born", "served", "war", "died", "donated", "museum", "family", "learning", "career", "would", "mastered"])
    history = "After moving north, Ann Lee mastered trades. Her wish of learning would last in her career."
    survives = "A square green glass lamp is covered with gold stripes on its flat base."
    cases = [None, "", "A red vase with a gold pattern. He was born in 1820 and served in the war.", "He died in 1820.", f"{history} {survives}", f"{survives}\n\n{history}"]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", visual.visual_text(F.col("t"), rules).alias("v"))
    got = {r["k"]: (r["v"]["text"], r["v"]["retained"]) for r in df.collect()}
    assert got[0] == (None, None) and got[1] == (None, None) and got[3] == (None, 0.0)
    assert got[2][0] == "A red vase with a gold pattern." and 0 < got[2][1] < 1
    assert got[4][0] == survives and got[5][0] == survives and got[5][1] == pytest.approx(len(survives) / len(cases[5]), rel=1e-6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_visual_sentences(spark):
    cases = ["Dr. A. Smith came. He left.", "Cut by Mrs. K. L. Orne in the U.S. Mint. It is blue.", 'She wrote "It is late." Then they ran!', "Made ca. 1870. Bound red.", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(cases)), "k int, t string").orderBy("k").select(visual.sentences(F.col("t"))).collect()]
    assert got == [["Dr. A. Smith came.", "He left."], ["Cut by Mrs. K. L. Orne in the U.S. Mint.", "It is blue."], ['She wrote "It is late."', "Then they ran!"], ["Made ca. 1870.", "Bound red."], []]
    terms = spark.createDataFrame([("Red",), ("red",), (None,), ("oak",)], "term string")
    assert visual.lexicon(terms) == ["oak", "red"]
    heard = spark.createDataFrame([("The dog ran, the dog!", "a DOG"), (None, "x"), ("b", None)], "r string, h string")
    assert [r[0] for r in heard.select(visual.unspoken_words(F.col("r"), F.col("h"))).collect()] == [["THE", "RAN"], [], ["B"]]


def test_turns(spark):
    text = "ORAL ARGUMENT OF MR. A\nMR. DOE: Hello\nthere. (Laughter.)\n\nCHIEF JUSTICE ROE: Yes.\nstray"
    df = spark.createDataFrame([("d1", text), ("d2", None), ("d3", "")], "docket string, transcript string")
    got = rows(Sp.parse_turns(df, ["docket"], "transcript").select("docket", "turn", "section", "speaker", "text"), "turn")
    assert got == [("d1", 0, 1, "MR. DOE", "Hello there."), ("d1", 1, 1, "CHIEF JUSTICE ROE", "Yes. stray")]


LAID_OUT = """APPEARANCES:
 1     ANN B. LEE, JR., ESQ., Washington; on behalf of
 2     the Petitioner.
 3     P R O C E E D I N G S
 4     (11:39 a.m.)
 5     ORAL ARGUMENT OF JOHN Q. POE
 6       ON BEHALF OF THE RESPONDENT
 7     CHIEF JUSTICE ROE:  We\u2019ll hear \u2013 well MS. LEE: Thank
 8     you.  (Whispers to
 9     the clerk.)
10     (Recess taken
11     until noon)
12     unknown: What -
99     not a body line
no number
13     JUSTICE SMITT. Go on.
14     THE COURT: Order, REBUTTAL
15     (Whereupon the case was submitted.)
16     word [3] 12:4"""


def test_laid_out_transcripts(spark):
    text = LAID_OUT.replace("APPEARANCES:", " 9     APPEARANCES:")
    df = spark.createDataFrame([("d", text), ("e", "nothing numbered")], "docket string, t string")
    got = rows(Sp.parse_turns(df, ["docket"], "t", laid_out=True).select("turn", "section", "speaker", "text"), "turn")
    assert got == [
        (0, 1, "CHIEF JUSTICE ROE", "We'll hear -- well"), (1, 1, "MS. LEE", "Thank you. (Whispers to the clerk.)"), (2, 1, "unknown", "What --"), (3, 1, "JUSTICE SMITT", "Go on."), (4, 1, "THE COURT", "Order, REBUTTAL"),
    ]
    named = Sp.appearances(df, ["docket"], "t", laid_out=True)
    assert {(r["name_key"], r["name"]) for r in named.collect()} >= {("LEE", "ANN B. LEE, JR."), ("B. LEE", "ANN B. LEE, JR."), ("ANN B. LEE", "ANN B. LEE, JR."), ("POE", "JOHN Q. POE")}
    early = spark.createDataFrame([("d", "some words\nMr. LEE: Hi\nMS ANN: Yes\n[Pause taken.]\nI SEE IT NOW\n(A note that\n" + "goes on\n" * 8 + "end)")], "docket string, t string")
    got = rows(Sp.parse_turns(early, ["docket"], "t").select("turn", "speaker", "text"), "turn")
    assert [(r[1], r[2][:30]) for r in got] == [("UNIDENTIFIED", "some words"), ("MR. LEE", "Hi"), ("MS. ANN", "Yes (A note that goes on goes o")][:3] or got[2][2].startswith("Yes (A note that goes on")


def test_speakers_are_resolved(spark):
    day, later = "2015-01-01", "2031-01-01"
    bench = spark.createDataFrame([("CHIEF JUSTICE ROE", "2000-01-01", None), ("JUSTICE SMITH", "2001-01-01", "2020-01-01"), ("JUSTICE KANE", "2021-01-01", None)], "name string, a string, b string").select("name", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"))
    labels = [("JUSTICE SMITT", day), ("JUSTICE SMITH", later), ("CHIEF JUSTICE", day), ("MS. LEE:", day), ("MR. LEEE", day), ("MR. KANE", later), ("THE COURT", day), ("UNIDENTIFIED", day), ("MR. FOE", day), (None, day), ("", day), ("MR. TYPO", day), ("JUSTICE SMITH", None)]
    df = spark.createDataFrame([(i, "d", s, t) for i, (s, t) in enumerate(labels)], "k int, docket string, speaker string, t string").withColumn("date", F.col("t").cast("date")).drop("t")
    named = spark.createDataFrame([("d", "GEN. ANN B. LEE, JR.", "LEE"), ("d", "GEN. ANN B. LEE, JR.", "B. LEE")], "docket string, name string, name_key string")
    fixes = spark.createDataFrame([("d", "MR. TYPO", "JUSTICE SMITH"), (None, "MR. TYPO", "MR. FOE")], "docket string, label string, fixed string")
    got = {r["k"]: (r["speaker_id"], r["role"]) for r in Sp.resolve_speakers(df, "speaker", "date", bench, "c", "docket", named, fixes).collect()}
    assert [got[i] for i in range(len(labels))] == [
        ("c:JUSTICE SMITH", "justice"), ("c:d:JUSTICE SMITH", "unknown"), ("c:CHIEF JUSTICE ROE", "justice"), ("c:adv:ANN LEE", "advocate"), ("c:adv:ANN LEE", "advocate"), ("c:JUSTICE KANE", "justice"), ("c:unknown", "unknown"),
        ("c:d:UNIDENTIFIED", "unknown"), ("c:d:MR. FOE", "advocate"), ("c:unknown", "unknown"), ("c:d:UNIDENTIFIED", "unknown"), ("c:JUSTICE SMITH", "justice"), ("c:d:JUSTICE SMITH", "unknown"),
    ]
    keys = spark.createDataFrame([("D. John Sauer",), ("Hon. Mary Ann Poe III",), ("Plato",), ("",), ("E JOSHUA ROSE",)], "n string").select(Sp.advocate_key(F.col("n")))
    assert [r[0] for r in keys.collect()] == ["JOHN SAUER", "MARY POE", "PLATO", "", "JOSHUA ROSE"]


def test_token_arrays_and_reattributions(spark):
    turns = spark.createDataFrame([("d", 0, "A", "A", "one two"), ("d", 1, "B", "C", "three"), ("d", 2, "A", "A", "")], "docket string, turn int, speaker string, was string, text string")
    r = Sp.token_arrays(turns, ["docket"]).first()
    assert (r["tokens"], r["turn_idx"], r["groups"], r["speakers"], r["roles"]) == (["one", "two", "three"], [0, 0, 1], [1, 1, 2], ["A", "A", "B"], [None] * 3)
    t = Sp.transcript_text(turns, ["docket"], was="was").first()
    assert [tuple(x) for x in t["reattributions"]] == [("C", "B", "three")] and t["transcript"].startswith("A: one two\nB: three")


def test_unspoken_words_and_blocks():
    ref, heard = "x1 x2 x3 x4 x5 a b c d e f g".split(), "a b c d e f g".split()
    at = Sp.anchors(ref, heard)
    assert Sp.unspoken(len(ref), len(heard), at) == [True] * 5 + [False] * 7
    assert not any(Sp.unspoken(len(ref), len(heard), at, most=3)) and not any(Sp.unspoken(5, 9, []))
    tail = heard + "t1 t2 t3 t4 t5 t6".split()
    assert Sp.unspoken(len(tail), len(heard), Sp.anchors(tail, heard)) == [False] * 7 + [True] * 6
    assert not any(Sp.unspoken(8, 8, [(0, 0), (5, 5)]))
    at = [(i, i) for i in range(0, 100, 5)]
    got = Sp.blocks(100, at, [float(i) for i in range(100)], 20.0)
    assert got[0][0] == 0 and got[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and all(b - a <= 20 for a, b in got)
    assert Sp.blocks(10, [], [], 5.0) == [(0, 10)] and Sp.blocks(0, [], [], 5.0) == []


def test_cuts_prefer_sentences():
    starts = [float(i) for i in range(6)]
    ends = [x + 1 for x in starts]
    stops = [t.endswith(".") for t in "One two. Three four five. Six".split()]
    assert Sp.cut_points(starts, ends, stops, 4.0) == [0, 0, 1, 1, 1, 1]
    assert Sp.cut_points([0.0, 9.0], [1.0, 10.0], [False, False], 100.0, 2.0) == [0, 1]
    assert Sp.cut_points([], [], [], 4.0) == [] and Sp.cut_points([0.0, 0.5, 9.0], [0.4, 8.0, 9.5], [True, False, False], 4.0) == [0, 1, 2]


def script(*turns, gap=0.3):
    """Tokens of turns (speaker, text, seconds a word, unspoken places, scores by place), one after another."""
    out, clock, n = [], 0.0, 0
    for turn, (speaker, text, seconds, unspoken, scores) in enumerate(turns):
        for k, token in enumerate(text.split()):
            silent = k in unspoken
            out.append(("r", turn, n, token, speaker, None if silent else clock, None if silent else clock + seconds, None if silent else scores.get(k, scores.get("all", -0.1)) * len(token), len(token), True, True, silent, 9))
            clock += 0 if silent else seconds + 0.05
            n += 1
        clock += gap
    return out


GOOD, A_LINE = {}, "a slow answer about the harbour and its keepers"


@pytest.mark.parametrize(
    ("turns", "gap", "texts"),
    [
        ([("a", "one two three four five six", 0.3, {2, 3}, GOOD)], 0.3, ["one two", "five six"]),
        ([("a", "other name read", 0.3, {0, 1, 2}, GOOD), ("b", "the true name then", 0.3, set(), GOOD)], 0.3, ["the true name then"]),
        ([("a", "they can't sound like her", 0.3, set(), {"all": -8.0}), ("b", "keeping public money for its harbours", 0.3, set(), {0: -5.0})], 0.3, ["they can't sound like her", "public money for its harbours"]),
        ([("a", "they can't sound like her", 0.3, set(), GOOD), ("b", "keeping public money for its harbours", 0.3, set(), {0: -5.0})], 0.3, ["they can't sound like her", "keeping public money for its harbours"]),
        ([("a", "ah pardon public money for its harbours", 0.3, {0, 1}, {2: -5.0})], 0.3, ["money for its harbours"]),
        ([("a", A_LINE, 0.3, set(), GOOD), *((s, t, 0.25, set(), GOOD) for s, t in (("b", "so"), ("a", "fine no"), ("b", "yet"), ("a", "sure"), ("b", "we did"))), ("a", "and who wrote the other letter then", 0.3, set(), GOOD)], 0.1, [A_LINE, "and who wrote the other letter then"]),
        ([("a", A_LINE, 0.3, set(), GOOD), ("b", "so", 0.25, set(), GOOD), ("a", "fine", 0.25, set(), GOOD)], 0.1, [A_LINE, "so", "fine"]),
        ([(s, t, 0.3, set(), GOOD) for s, t in (("a", "sure"), ("b", "never"), ("a", "often"), ("b", "good"))], 4.0, ["sure", "never", "often", "good"]),
    ],
)
def test_segmenter(spark, turns, gap, texts):
    tokens = script(*turns, gap=gap)
    df = spark.createDataFrame(tokens, "rec string, turn int, token_no int, token string, speaker string, start double, end double, score double, count int, content boolean, ok boolean, unspoken boolean, piece int")
    got = Sp.segments(df.drop("piece"), ["rec"], F.lit(1000.0)).orderBy("segment").collect()
    assert [r["text"] for r in got] == texts
    times = {t[2]: (t[5], t[6]) for t in tokens}
    for r in got:
        assert r["start"] <= times[r["first_token"]][0] and r["end"] >= times[r["first_token"] + r["n_tokens"] - 1][1]
    if texts[-1] == "public money for its harbours":
        assert got[1]["start"] == times[5][1]  # padding stops at the trimmed word


def test_segments_of_nothing(spark):
    df = spark.createDataFrame([], "rec string, turn int, token_no int, token string, speaker string, start double, end double, score double, count int, content boolean, ok boolean, unspoken boolean")
    assert Sp.segments(df, ["rec"], F.lit(1.0)).count() == 0


def test_anchors():
    assert Sp.anchors("a b c d e f".split(), "x b c d y e f".split()) == [(1, 1)]
    assert Sp.anchors([], []) == []


def test_replaced_rows(spark):
    import pandas as pd

    df = spark.createDataFrame([("d", "x y"), ("e", "")], "docket string, text string")
    def split(batch):
        found = [(i, w) for i, t in enumerate(batch["text"]) for w in t.split()]
        return pd.DataFrame({"word": [w for _, w in found]}, dtype=object), [i for i, _ in found]

    assert rows(Sp.replace_rows(df, split, "word string", ["docket"])) == [("x", "d"), ("y", "d")]


def test_samplers(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    b = S.shuffled_batches(df, "k", 32, (0, 1), 3).collect()
    assert len(b) == 2 * 96 and len({r["k"] for r in b if r["pass"] == 0}) == 96
    assert S.batch_ends(np.array([3, 5, 5, 9, 20, 40]), 20) == [3, 4, 5, 6] and S.batch_ends(np.array([]), 20) == []
    mixed = df.select("k", F.when(F.col("k") < 30, "a").otherwise("b").alias("s"))
    both = {(r["chunk"], r["s"], r["position"]): r["k"] for r in S.mixture_chunks(mixed, "s", "k", {"a": 1, "b": 1}, 80, [0, 1], 1).collect()}
    again = {(r["chunk"], r["s"], r["position"]): r["k"] for r in S.mixture_chunks(mixed, "s", "k", {"a": 1, "b": 1}, 80, [1], 1).collect()}
    assert len(both) == 160 and all(both[k] == v for k, v in again.items())
    first = [both[k] for k in sorted(both) if k[1] == "a"][:30]
    assert sorted(first) == list(range(30))
    with pytest.raises(ValueError):
        S.mixture_chunks(mixed, "s", "k", {"c": 1}, 8, [0])


def test_crop_draws(spark):
    df = spark.createDataFrame([("a", 30.0), ("b", 3.0), ("c", 1.0), ("z", -4.0), ("n", None), (None, 9.0)], "k string, d double")
    got = S.crop_draws(df, "k", "d", 3.0, 4, 4000, 2).collect()
    share = {x: sum(r["k"] == x for r in got) / 4000 for x in "abczn"}
    assert len(got) == 4000 and share["z"] == share["n"] == 0 and abs(share["a"] - 12 / 16) < 0.03 and abs(share["c"] - 1 / 16) < 0.02


def test_held_out(spark):
    df = spark.createDataFrame([(str(i % 40), "train") for i in range(200)] + [(None, "test"), (None, "validation")], "speaker string, split string")
    got = S.held_out_split(df, "speaker", percent=20, operate_on="train").collect()
    by = {}
    for r in got:
        by.setdefault(r["speaker"], set()).add(r["split"])
    assert all(len(v) == 1 for k, v in by.items() if k) and by[None] == {"test"}


def test_record_formats(spark):
    entity = '{"id":"M1","pageid":5,"title":"File:A b.jpg","labels":{"en":{"value":"Lab"}},"statements":{"P275":[{"mainsnak":{"datavalue":{"value":{"id":"Q6938433"}}}}],"P1163":[{"mainsnak":{"datavalue":{"value":"image/jpeg"}}}],"P2049":[{"mainsnak":{"datavalue":{"value":{"amount":"+4000"}}}}],"P170":[{"mainsnak":{},"qualifiers":{"P2093":[{"datavalue":{"value":"Ann"}}]}}]}},'
    lines = spark.createDataFrame([("[",), (entity,), ('{"id":"M2","statements":[]}',)], "value string")
    kept = R.candidate_lines(lines, ['"Q6938433"'])
    got = R.entity_statements(kept, {"Q6938433": "CC0"}, {"Q19652": "PD"}, "Q60671452", "PD-USGov", ["image/jpeg"], "https://u", "https://s", 960).first()
    assert (got["id"], got["license"], got["creator"], got["width"], got["description"], got["title"]) == ("M1", "CC0", "Ann", 4000, "Lab", "A_b.jpg")
    assert got["image_url"].startswith("https://u/thumb/") and got["image_url"].endswith("/960px-A_b.jpg")
    museum = '{"content":{"descriptiveNonRepeating":{"record_ID":"r","guid":"g","title":{"content":"T &amp; x"},"online_media":{"media":[{"idsId":"i1","type":"Images","usage":{"access":"CC0"},"resources":[{"dimensions":"x"},{"dimensions":"30x40"}]},{"idsId":"i2","type":"Images","usage":{"access":"no"}}]}},"indexedStructured":{},"freetext":{"notes":[{"label":"Desc","content":"<i>N</i>"},{"label":"Desc","content":"M"}],"name":[{"label":"Artist","content":"Bo"}]}}}'
    got = R.online_media(spark.createDataFrame([(museum,), ("{}",)], "value string"), {"CC0": "CC0"}, ["Images"], ["Desc"], "https://ids", 100).collect()
    assert [(r["id"], r["width"], r["height"], r["description"], r["creator"], r["title"]) for r in got] == [("i1", 30, 40, "N\n\nM", "Artist: Bo", "T & x")]
    item = '{"data":[{"nasa_id":"a b","media_type":"image","title":"T","keywords":["k"],"photographer":"P"}],"links":[{"href":"http://x/a~thumb.jpg","render":"image"},{"href":"http://x/a~orig.jpg","render":"image","rel":"canonical","width":5}]}'
    got = R.library_items(spark.createDataFrame([(item,)], "value string"), "PD-USGov", "raw", "https://s", ["orig", "thumb"], ["secret"]).first()
    assert (got["image_url"], got["creator"], got["source_url"], got["width"], got["keywords"]) == ("https://x/a~orig.jpg", "P", "https://s/a%20b", 5, ["k"])
    record = '{"id":"/1/x","rights":["cc0"],"dataProvider":["D"],"language":["nl"],"edmPreview":["https://t/i?uri=https%3A%2F%2Fo%2Fp.jpg"],"dcTitleLangAware":{"def":["https://no","Titel"]},"dcCreatorLangAware":{"nl":["B","B"]}}'
    got = R.aggregated(spark.createDataFrame([(record,)], "value string"), {"cc0": "CC0"}, "https://s", {"D": ["why"]}).first()
    assert (got["id"], got["image_url"], got["title"], got["creator"], got["generation_exclusion_reasons"]) == ("1/x", "https://o/p.jpg", "Titel", "B", ["why"])
    work = '{"object_number":"K1","rights":"cc","public_domain":true,"image_thumbnail":"https://t","titles":[{"title":"Dansk","language":"dansk"},{"title":"English","language":"engelsk"}],"production":[{"creator":"C"},{"creator":"C"}]}'
    got = R.gallery_works(spark.createDataFrame([(work,)], "value string"), {"cc": "CC0"}, {"engelsk": "en", "dansk": "da"}, ["en", "da"]).first()
    assert (got["title"], got["text_language"], got["creator"]) == ("English", "en", "C")
    with pytest.raises(ValueError):
        R.require_canonical(["x"], {"y": "CC0"})


RECORD = """<record xmlns="http://www.openarchives.org/OAI/2.0/"><header{status}><identifier>oai:{id}</identifier></header><metadata>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ore="http://www.openarchives.org/ore/terms/" xmlns:edm="http://www.europeana.eu/schemas/edm/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:skos="http://www.w3.org/2004/02/skos/core#">
<edm:ProvidedCHO rdf:about="{id}"><dc:title xml:lang="nl">Titel</dc:title><dc:title xml:lang="en">A  title</dc:title><dc:description>Plain &amp; short</dc:description><dc:creator rdf:resource="a1"/><dc:creator rdf:resource="a1"/><dc:creator rdf:resource="none"/></edm:ProvidedCHO>
<ore:Aggregation><edm:rights rdf:resource="{right}"/><edm:isShownBy rdf:resource="https://i/{id}.jpg"/><edm:isShownAt rdf:resource="https://s/{id}"/></ore:Aggregation>
<edm:Agent rdf:about="a1"><skos:prefLabel xml:lang="nl">Jan</skos:prefLabel><skos:prefLabel xml:lang="en">John</skos:prefLabel></edm:Agent></rdf:RDF></metadata></record>"""


def test_harvested_xml(spark):
    rows_in = [(RECORD.format(id="x1", right="pd", status=""),), (RECORD.format(id="x2", right="pd", status=' status="deleted"'),), (RECORD.format(id="x3", right="other", status=""),), ("<record><broken",), (None,), ("<record><header/></record>",)]
    df = R.harvested_xml(spark.createDataFrame(rows_in, "value string"), {"pd": "PD"}, ["en", "nl"])
    got = df.collect()
    assert [(r["id"], r["license"], r["creator"], r["title"], r["description"], r["image_url"], r["source_url"], r["text_language"]) for r in got] == [("x1", "PD", "John", "A title", "Plain & short", "https://i/x1.jpg", "https://s/x1", "def")]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    page = f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{RECORD.format(id="y", right="pd", status="")}<resumptionToken> t2 </resumptionToken></ListRecords></OAI-PMH>'
    records, token = R.harvest_page(page)
    assert token.strip() == "t2" and R.harvested_xml(spark.createDataFrame([(records[0],)], "value string"), {"pd": "PD"}, ["nl"]).first()["creator"] == "Jan"
    assert R.harvest_page("<a><ListRecords/><resumptionToken/></a>") == ([], None)
    with pytest.raises(ValueError):
        R.harvest_page('<a><error code="badArgument"/></a>')


def test_zipped_columns_and_offsets(spark):
    a, b = spark.createDataFrame([(2, "b"), (1, "a")], "k int, x string"), spark.createDataFrame([(9, "z"), (8, "y")], "o int, w string")
    assert sorted(rows(U.zip_columns(a, b, ["k"], ["o"]))) == [(1, "a", 8, "y"), (2, "b", 9, "z")]
    with pytest.raises(Exception, match="differ in length"):
        U.zip_columns(a, b.limit(1), ["k"], ["o"]).collect()
    with pytest.raises(ValueError):
        U.zip_columns(a, a, ["k"], ["k"])
    got = U.mixture_rows({"s": a, "t": b.select(F.col("o").alias("k"), F.col("w").alias("x"))}, {"s": ["k"], "t": ["k"]})
    assert sorted(rows(got.select("row", "source_name", "k"))) == [(0, "s", 1), (1, "s", 2), (2, "t", 8), (3, "t", 9)]


def test_last_word_join(spark):
    speakers = spark.createDataFrame([("court JUSTICE ROE",), ("ROE",), ("a b",), (None,), ("x ROE ",)], "speaker string")
    names = spark.createDataFrame([("Ann ROE", 1), ("ROE", 2), (None, 3), ("b", 4)], "name string, n int")
    assert set(rows(J.join_last_word(speakers, names, "speaker", "name").select("speaker", "n"))) == {("court JUSTICE ROE", 1), ("court JUSTICE ROE", 2), ("a b", 4)}


def test_media_kernels(spark):
    import pandas as pd

    df = spark.createDataFrame([([0.0, 0.0, 0.0, 4.0],), ([1.0, 1.0],), ([],), (None,)], "r array<double>")
    got = [r[0] for r in df.select(media.pulse_sharpness(F.col("r"))).collect()]
    assert got[0] == pytest.approx(7 / 3) and got[1:] == [None, None, None]
    t = np.arange(2048) / 8000
    voiced = sum(np.sin(2 * np.pi * 120 * k * t) / k for k in range(1, 20))
    high, noise, short = media.cepstral_peak(pd.Series([voiced, np.random.default_rng(0).normal(size=2048), [0.0] * 9]), 8000, 60, 400)
    assert high > noise and (short is None or short != short)
    assert media.padded(pd.Series([[[1, 2, 3], [4, 5, 6]]]), 3, 2).iloc[0] == [[1, 2], [4, 5], [0, 0]]
    pdf = spark.createDataFrame([(bytearray(b"%PDF a"),), (bytearray(b"bad"),), (None,)], "b binary").select(media.pdf_texts(lambda d: d.decode().split("%PDF ")[1])(F.col("b")))
    assert [r[0] for r in pdf.collect()] == ["a", None, None]


def test_ingest_dedupes_over_units(spark):
    schema = "id string, license_raw string, source_url string, image_url string, title string"
    a = spark.createDataFrame([("x1", "r", "s", "i", "a"), ("x3", "r", "s", "i", "a")], schema)
    b = spark.createDataFrame([("x3", "r", "s", "i", "b"), ("x4", "r", "s", "i", "b"), ("x4", "r", "s", "i", "b")], schema)
    assert sorted((r["id"], r["title"]) for r in R.ingest([a, b, a.limit(0)]).collect()) == [("x1", "a"), ("x3", "a"), ("x4", "b")]
    assert R.ingest([a, b], dedupe=False).count() == 5


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", None)], "child string, parent string")
    assert rows(L.ancestry(edges, spark.createDataFrame([("a",)], "n string")), "depth") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    records = spark.createDataFrame([("root", "2031-01-02T00:00", ["p/", "p"], ["m"]), ("zzz", None, None, None)], "name string, produced_on string, datasets array<string>, models array<string>")
    declared = spark.createDataFrame([("root/", ["q", "p"]), ("q", ["root"])], "name string, datasets array<string>")
    graph = L.mermaid(records, "root/", declared, {"p": "alias"})
    assert graph.splitlines() == ["flowchart BT", '  n0["root<br/>2031-01-02"]', '  n1["alias"]', "  class n1 leaf", '  n2(["m"])', "  class n2 leaf", '  n3["q"]', "  class n3 leaf", "  n1 --> n0", "  n2 --> n0", "  n3 -.-> n0", "  n0 -.-> n3", "  classDef leaf stroke-dasharray: 4 4"]
    chain = spark.createDataFrame([(f"d{i}", None, [f"d{i + 1}", 'a"b'], None) for i in range(6)], records.schema)
    assert L.graph_nodes(L.parent_edges(chain), "d0", max_nodes=4).count() == 4
    assert '#quot;' in L.mermaid(chain, "d0") and L.mermaid(records.limit(0), "x").splitlines()[1:3] == ['  n0["x"]', "  class n0 leaf"]


def test_media_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (7).to_bytes(2, "big") + (9).to_bytes(2, "big") + b"\0\0"
    assert media.image_size(png) == (3, 4) and media.image_size(jpeg) == (9, 7)
    assert media.image_size(b"junk") == (None, None) == media.image_size(None)


def test_training_rows(spark):
    from millrace.functions.multimodal import Marks, training_rows

    df = spark.createDataFrame([(1, [5, 6], 2, True), (2, [5], 1, False), (3, [5], None, None), (4, None, 0, True)], "k int, ids array<int>, n int, made boolean")
    got = {r["k"]: (r["input_ids"], r["modality_ids"], r["loss_mask"]) for r in training_rows(df, "ids", "n", "made", Marks(90, 91, 92, 99)).collect()}
    assert got[1] == ([5, 6, 90, 91, 91, 92, 99], [0, 0, 0, 1, 1, 1, 0], [False, False, True, True, True, True, True])
    assert got[2] == ([90, 91, 92, 5, 99], [0, 1, 1, 0, 0], [False, False, False, True, True])
    assert got[3] == ([5, 99], [0, 0], [True, True])
    assert got[4] == ([90, 92, 99], [0, 1, 0], [True, True, True])


def test_bit_parallel_edits():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        assert X.edits(a, b) == plain(a, b)
    assert X.edits([], list("ab")) == 2 and X.edits(list("ab"), []) == 2 and X.edits([], []) == 0


def test_timed_tokens(spark):
    df = spark.createDataFrame([(1, "ab cdef", 0.0, 6.0), (2, "x", 1.0, 1.0), (3, None, 0.0, 1.0), (4, "", 0.0, 1.0), (5, "x", None, 2.0)], "k int, t string, a double, b double")
    assert rows(Sp.timed_tokens(df, ["k"], "t", "a", "b"), "token_no") == [(1, 0, "ab", 0.0, 2.0), (1, 1, "cdef", 2.0, 6.0)]
    assert rows(Sp.segment_turns(Sp.timed_tokens(df, ["k"], "t", "a", "b"), ["k"], 5.0)) == [(1, 0, 0, 1, "ab", 0.0, 2.0), (1, 1, 1, 1, "cdef", 2.0, 6.0)]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_char_error_counts_take_every_segment(spark, tmp_path):
    from millrace.queries import core

    pairs = [("a", "Café naïve", "cafe naive"), ("a", "x" * 450 + "Y", "x" * 440 + "z"), ("b", "漢字😀", "漢😀字"), ("b", None, "abc"), (None, "Ab", None)]
    spark.createDataFrame(pairs, "source string, text_original string, text_normalized string").write.parquet(f"{tmp_path}/segments.parquet")
    want = {}
    for s, h, r in pairs:
        edits, chars = want.get(s, (0, 0))
        want[s] = edits + _levenshtein((h or "").lower(), (r or "").lower()), chars + len(r or "")
    assert {r["source"]: (r["char_edits"], r["chars"]) for r in core.char_error_counts(spark, str(tmp_path)).collect()} == want


def test_padded_batches_hold_whole_texts(spark, tmp_path):
    from millrace.queries import extended

    long = " ".join(["word"] * 3000)
    spark.createDataFrame([(0, "a bb"), (1, long), (16, "ccc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["batch"]: r for r in extended.padded_batches(spark, str(tmp_path)).collect()}
    assert got[0]["length"] == 3000 and got[0]["lengths"] == [2, 3000]
    assert got[0]["values"] == [[1.0, 2.0] + [0.0] * 2998, [4.0] * 3000]
    assert got[1]["values"] == [[3.0]]


def test_clean_html_keeps_texts_with_entities(spark, tmp_path):
    from millrace.queries import extended

    texts = ["plain <b>text</b>", "Tom &amp; Ann&nbsp;&eacute;", "R&D", "&lt;i&gt;x&#33;", "&nbsp;", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(extended.clean_html(spark, str(tmp_path)), "doc_id") == [(0, "plain text"), (1, "Tom & Ann é"), (2, "R&D"), (3, "x!"), (4, None)]


def test_turns_of_unknown_speakers_and_labels_inside_lines(spark):
    import datetime

    text = "unknown: First.\nMR. DOE: Hello. JUSTICE ROE: Why? CHIEF JUSTICE POE. Go on.\nunknown: An unknown: thing.\nMS. LEE: I told Mr. Doe: no. It's MR. DOE here."
    turns = Sp.parse_turns(spark.createDataFrame([("d", datetime.date(2020, 1, 1), text)], "docket string, day date, transcript string"), ["docket", "day"], "transcript")
    assert rows(turns.select("turn", "speaker", "text", "line_start"), "turn") == [
        (0, "unknown", "First.", 1), (1, "MR. DOE", "Hello.", 2), (2, "JUSTICE ROE", "Why?", 2), (3, "CHIEF JUSTICE POE", "Go on.", 2),
        (4, "unknown", "An unknown: thing.", 3), (5, "MS. LEE", "I told Mr. Doe: no. It's MR. DOE here.", 4),
    ]
    bench = spark.createDataFrame([("Justice Roe", datetime.date(2000, 1, 1), None)], "name string, start_date date, end_date date")
    got = rows(Sp.resolve_speakers(turns, "speaker", "day", bench, "court").select("turn", "speaker_id", "role"), "turn")
    assert [r[1:] for r in got] == [("court:unknown", "unknown"), ("court:adv:DOE", "advocate"), ("court:JUSTICE ROE", "justice"), ("court:unknown", "unknown"), ("court:unknown", "unknown"), ("court:adv:LEE", "advocate")]


def test_all_customers_are_roots_and_all_orders_indexed(spark, tmp_path):
    from millrace.queries import core, extended

    for name, data, kind in [("customer", [(1, 7), (50, 8), (51, 7)], "c_custkey long, c_nationkey int"), ("nation", [(7, 2), (8, 2)], "n_nationkey int, n_regionkey int"), ("orders", [(1, 5.0), (3, 6.0), (4, 7.0)], "o_orderkey long, o_totalprice double")]:
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(f"c{c}", n, i) for c, k in [(1, 7), (50, 8), (51, 7)] for i, n in enumerate([f"c{c}", f"n{k}", "r2"])}
    got = rows(extended.ancestry_closure(spark, str(tmp_path)))
    assert set(got) == want and len(got) == 9
    assert rows(core.index_source_join(spark, str(tmp_path)), "row") == [(0, 1, 5.0, 0), (1, 3, 6.0, 2), (2, 4, 7.0, 4)]


def test_placeholders_are_expanded(spark):
    from millrace.functions.multimodal import Medium, expand_placeholders

    kinds = {"voice": Medium(70, 90, 91, 92, 1), "image": Medium(80, 95, 96, 97, 2)}
    schema = "k int, ids array<int>, voice array<int>, image array<int>"
    df = spark.createDataFrame([(1, [70, 5, 70, 80], [1, 0], [2]), (2, [], None, []), (3, None, None, None), (4, [5], [], None)], schema)
    got = {r["k"]: (r["input_ids"], r["modality_ids"], r["loss_mask"], r["n_positions"]) for r in expand_placeholders(df, "ids", kinds, 99).collect()}
    assert got[1][0] == [90, 91, 92, 5, 90, 92, 95, 96, 96, 97, 99] and got[1][1] == [0, 1, 1, 0, 0, 1, 0, 2, 2, 2, 0]
    assert got[1][2] == [False, False, False, True, False, False, False, False, False, False, True] and got[1][3] == 11
    assert got[2] == got[3] == ([99], [0], [True], 1) and got[4][0] == [5, 99]
    for row in [(1, [70], [], None), (1, [5], [3], None)]:
        with pytest.raises(Exception, match="placeholder"):
            expand_placeholders(spark.createDataFrame([row], schema), "ids", kinds, 99).collect()


def test_task_columns_and_constants(spark):
    df = spark.createDataFrame([(1, "a", "t", 2)], "row int, id string, text string, z int")
    assert P.select_task_columns(df, {"text": ["text", "lang"]}, ["text"]).columns == ["row", "id", "text"]
    with pytest.raises(ValueError):
        P.select_task_columns(df, {}, ["text"])
    assert rows(P.add_constants(df, {"c": "x"})) == [(1, "a", "t", 2, "x")]
    with pytest.raises(ValueError):
        P.add_constants(df, {"z": 1})


def test_checks_and_bounds(spark):
    from millrace.operators import validate as V

    found = spark.createDataFrame([("a", 1)], "check string, k int")
    with pytest.raises(ValueError, match="some"):
        V.require_none({"some": found, "none": found.limit(0)})
    V.require_none({"none": found.limit(0)})
    rated = spark.createDataFrame([(10, 0.5, 0.0, None)], "n long, tiny double, slow double, fast double")
    assert rows(V.broken_bounds(rated)) == [("tiny", 0.5, 0.01)] and V.broken_bounds(rated.withColumn("tiny", F.lit(0.0))).count() == 0


def test_media_bytes(spark):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 4000)
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (2).to_bytes(2, "little")
    df = spark.createDataFrame([(0, bytearray(out.getvalue())), (1, bytearray(gif)), (2, bytearray(b"junk")), (3, None)], "k int, b binary").orderBy("k")
    assert [r[0] for r in df.select(media.wav_seconds(F.col("b"))).collect()] == [0.5, None, None, None]
    sizes = df.select(media.image_sizes(F.col("b")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in sizes] == [(None, None), (3, 2), (None, None), (None, None)]


def test_small_rules(spark):
    assert S.resume_at(iter([3, 2, 4]), 0) == (0, 0) and S.resume_at(iter([3, 2, 4]), 4) == (1, 1) and S.resume_at(iter([3]), 3) == (1, 0)
    texts = spark.createDataFrame([("Café ÑANDÚ",), (None,)], "t string")
    assert [r[0] for r in texts.select(X.plain_letters(F.col("t"))).collect()] == ["Cafe NANDU", None]
    f0 = spark.createDataFrame([([0.0, 1.0, 2.718281828459045], 0.5, 0.5), ([1.0], 0.0, 0.0), (None, 1.0, 1.0)], "f array<double>, m double, s double")
    got = [r[0] for r in A.z_scored_f0(f0, "f", "m", "s").select("f0_z").collect()]
    assert got[0] == pytest.approx([0.0, -1.0, 1.0]) and got[1] == [None] and got[2] is None


def test_checkpoints_are_deleted(spark):
    from pathlib import Path

    from millrace.session import cut, drop, sweep

    a, b = cut(spark.range(3)), cut(spark.range(4))
    held = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    n = len(list(held.iterdir()))
    drop(a)
    drop(b.select("id"))
    drop(spark.range(3))
    assert len(list(held.iterdir())) == n - 1 and b.count() == 4
    sweep(spark)
    assert not list(held.iterdir())
