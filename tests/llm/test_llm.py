import math
import re
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import cutoffs, entity_splits, mixing, oversized, packing, reading_level, tokens

NAN, INF = float("nan"), float("inf")
SOURCES = "source int, weight double, max_repeats int, keep_pct int, score_field string, max_segment_seconds double, overlap_seconds double"


# mixing -------------------------------------------------------------------------------------------


def naive(weights, seats, caps):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [k for k in sorted(weights) if weights[k] > 0 and out[k] < caps[k]]
        if not open_:
            break
        out[max(open_, key=lambda k: weights[k] / (2 * out[k] + 1))] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 6), st.integers(0, 40), min_size=1), st.integers(0, 120), st.lists(st.integers(0, 60), min_size=7, max_size=7))
def test_sainte_lague_gives_the_highest_quotients(weights, seats, caps):
    caps = {k: caps[k] for k in weights}
    got = mixing.sainte_lague(weights, seats, caps)
    want = naive(weights, seats, caps)
    assert sum(got.values()) == sum(want.values()) and all(got[k] <= caps[k] for k in got)
    # equal quotients may be given to either key; the quotients themselves are the same
    quotients = lambda g: sorted(weights[k] / (2 * i + 1) for k, n in g.items() for i in range(n))
    assert quotients(got) == pytest.approx(quotients(want))


def test_many_seats_cost_little():
    got = mixing.sainte_lague({1: 1.0, 2: 3.0}, 4 * 10**9)
    assert got[1] == 10**9 and got[2] == 3 * 10**9


def mixture_input(spark):
    rows = [(f"a{i}", 1, 10.0) for i in range(300)] + [(f"b{i}", 2, 5.0) for i in range(40)] + [(f"a{i}", 1, 10.0) for i in range(50)]
    rows += [(None, 1, 9.0), ("x", None, 9.0), ("n", 1, NAN), ("i", 1, INF), ("m", 1, -3.0), ("z", 1, 0.0), ("q", 3, 9.0), ("u", 1, None)]
    sources = [(1, 0.5, 1, 50, "s", 9.0, 1.0), (2, 0.5, 3, 50, "s", 9.0, 1.0), (3, None, 1, 50, "s", 9.0, 1.0), (4, 0.0, 1, 50, "s", 9.0, 1.0), (None, 1.0, 1, 50, "s", 9.0, 1.0)]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "id string, source int, duration_s double, block string, copies int"), spark.createDataFrame(sources, SOURCES).where("source is not null")


def test_mixture_keeps_caps_and_shares(spark):
    df, sources = mixture_input(spark)
    mixture, report = mixing.mix(df, sources, "duration_s", block=10.0)
    got = mixture.collect()
    assert len({r["id"] for r in got}) == len(got)
    assert max(r["copies"] for r in got if r["source"] == 1) == 1 and max(r["copies"] for r in got if r["source"] == 2) <= 3
    assert not {r["id"] for r in got} & {"x", "n", "i", "m", "z", "q", "u", None}
    by = {r["source"]: r for r in report.collect()}
    assert by[1]["own_size"] == 3000 and by[2]["own_size"] == 200 and set(by) == {1, 2, 4}
    assert by[2]["short"] and not by[1]["short"] and by[2]["reached_size"] == 600
    assert sum(r["size"] * r["copies"] for r in got) == pytest.approx(by[1]["reached_size"] + by[2]["reached_size"])
    again = mixing.mix(df.repartition(7), sources, "duration_s", block=10.0)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixture_reaches_target_shares(spark):
    rows = [(f"{s}-{i}", s, 5.0 + i % 7) for s, n in ((1, 2000), (2, 1000), (3, 300)) for i in range(n)]
    sources = spark.createDataFrame([(1, 2.0, 1, 1, "s", 1.0, 0.0), (2, 1.0, 2, 1, "s", 1.0, 0.0), (3, 1.0, 4, 1, "s", 1.0, 0.0)], SOURCES)
    report = mixing.mix(spark.createDataFrame(rows, "id string, source int, duration_s double"), sources, "duration_s", total=10_000.0)[1]
    for r in report.collect():
        assert abs(r["reached_share"] - r["target_share"]) < 0.02


def test_shards_are_bounded_whatever_the_records(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    monkeypatch.setattr(mixing, "SHARDS", 4)
    sources = spark.createDataFrame([(1, 2.0, 1, 1, "s", 1.0, 0.0), (2, 1.0, 3, 1, "s", 1.0, 0.0)], SOURCES)
    for n in (400, 4000):
        rows = [(f"{s}-{i}", s, 5.0 + i % 7) for s, k in ((1, n), (2, n // 5)) for i in range(k)]
        df = spark.createDataFrame(rows, "id string, source int, duration_s double")
        plan = mixing.Plan(df, sources, "duration_s", "id", "source", None, 30.0)
        placed, stretches, parts = mixing._placed(plan.records, plan.sums, "id", "source", 30.0, 11)
        assert len(parts) <= 4 * 2 and stretches.count() >= n // 100
        # blocks follow one another in a shard's order, over all its stretches
        for s, shard in {(r["source"], r["shard"]) for r in parts}:
            own = sorted(r["block"] for r in placed.where(f"source = {s} and shard = {shard}").collect())
            assert own[0] == 0 and all(b - a <= 1 for a, b in zip(own, own[1:], strict=False))
        report = {r["source"]: r for r in mixing.mix(df, sources, "duration_s")[1].collect()}
        assert all(abs(r["reached_share"] - r["target_share"]) < 0.05 for r in report.values()) or report[2]["short"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 4000), st.integers(0, 5)), min_size=1, max_size=12))
def test_short_sources_are_held_by_their_cap(rows):
    block = 30.0
    weight = {i: float(w) for i, (w, _, _) in enumerate(rows)}
    most = {i: float(r * s) for i, (_, s, r) in enumerate(rows)}
    aim = float(sum(s for _, s, _ in rows))
    share = {i: w / (sum(weight.values()) or 1.0) for i, w in weight.items()}
    cap = {i: int(x / block) for i, x in most.items()}
    quota = mixing.sainte_lague(weight, round(aim / block), cap)
    assert mixing.short_sources(quota, cap, share, most, aim) == {i for i in weight if most[i] < share[i] * aim}


def test_mixture_of_nothing(spark):
    df, sources = mixture_input(spark)
    mixture, report = mixing.mix(df.limit(0), sources, "duration_s")
    assert mixture.count() == 0 and all(r["reached_size"] == 0 for r in report.collect())


# grouped splits -----------------------------------------------------------------------------------


def naive_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for r, e in edges:
        if r is not None and e is not None:
            by.setdefault(r, []).append(e)
    for es in by.values():
        for e in es[1:]:
            parent[find(e)] = find(es[0])
    out = {}
    for e in {e for es in by.values() for e in es}:
        out.setdefault(find(e), set()).add(e)
    return {frozenset(s) for s in out.values() if len(s) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), f"e{rng.randrange(60)}") for _ in range(80)] + [(None, "e1"), (1, None), (99, "e5"), (99, "e5")]
    got = {}
    for r in entity_splits.components(spark.createDataFrame(edges, "record int, entity string")).collect():
        got.setdefault(r["component"], set()).add(r["entity"])
    assert {frozenset(s) for s in got.values()} == naive_components(edges)
    assert all(c == min(s) for c, s in got.items())


def test_hubs_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(entity_splits, "HOT", 10)
    edges = [(i, e) for i in range(60) for e in ("hub", f"s{i:02d}")] + [(100 + i, e) for i in range(30) for e in (f"c{i:02d}", f"c{i + 1:02d}")]
    got = {}
    for r in entity_splits.components(spark.createDataFrame(edges, "record int, entity string")).collect():
        got.setdefault(r["component"], set()).add(r["entity"])
    assert {k: len(v) for k, v in got.items()} == {"hub": 61, "c00": 31}


def test_long_chain_in_few_rounds(spark):
    edges = [(i, f"{j:04d}") for i in range(300) for j in (i, i + 1)]
    random.Random(1).shuffle(edges)
    got = entity_splits.components(spark.createDataFrame(edges, "record int, entity string")).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {"0000"}


def test_no_edges(spark):
    assert entity_splits.components(spark.createDataFrame([], "record int, entity string")).count() == 0


def test_entity_keys(spark):
    df = spark.createDataFrame([(" A:b　1 ",), ("a:B1",), ("a:Unknown",), ("UNKNOWN",), (" ",), (None,), ("a:unknown2",)], "s string")
    assert [r[0] for r in df.select(entity_splits.entity_key(F.col("s"))).collect()] == ["a:b1", "a:b1", None, None, None, None, "a:unknown2"]


def split_input(spark, n=3000):
    rng = random.Random(2)
    rows = [(i, f"r{i}", f"p:{min(int(rng.expovariate(0.03)), 400)}" if i % 3 else "P : 0", i % 4 if i % 11 else None) for i in range(n)]
    rows += [(n, "r0", None, 1), (n + 1, "same", "p:unknown", 1), (n + 2, "same", "", 2)]
    links = [(1, "p:1", "P:2"), (2, "p:2", "p:3"), (3, "p:9", None), (4, "p:9", "p:9"), (5, "p:8", "p:unknown"), (6, "p:7", "p:unknown"), (7, "p:1", "P: 2")]
    segments = spark.createDataFrame([(*r, "old") for r in rows], "seg_row long, id string, speaker_id string, source int, split string")
    return segments, spark.createDataFrame(links, "link_id int, speaker_id string, same_as string")


def test_splits_keep_groups_and_shares(spark):
    segments, links = split_input(spark)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split string, target_share double")
    grouped = entity_splits.with_groups(segments, "speaker_id", links, "speaker_id", "same_as", "link_id", F.col("id"), "person")
    got = entity_splits.grouped_split(grouped, "person", "source", targets).collect()
    assert len(got) == segments.count()
    by = {}
    for r in got:
        by.setdefault(r["person"], set()).add(r["new_split"])
    assert all(len(s) == 1 for s in by.values())
    person = {r["speaker_id"]: r["person"] for r in got}
    assert person["p:1"] == person["p:2"] == person["p:3"] and person["p:8"] != person["p:7"]
    assert {r["person"] for r in got if r["id"] == "same"} == {"r:same"}
    shares = {s: sum(r["new_split"] == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    for label in (0, 1, 2, 3):
        own = [r for r in got if r["source"] == label]
        assert abs(sum(r["new_split"] == "train" for r in own) / len(own) - 0.8) < 0.06


@pytest.mark.parametrize("labels", [5, 900])
def test_every_label_is_spread(spark, labels):
    """Few labels have a place of their own, many share places; either way each is spread by the shares."""
    rng = random.Random(9)
    rows = [(f"g{i}", f"l{rng.randrange(labels)}") for i in range(1500) for _ in range(rng.choice([1, 2, 30]))] + [("g0", None)] * 5 + [(None, "l1")] * 5
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "grp string, label string, item string, big boolean")
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    got = entity_splits.grouped_split(df, "grp", "label", targets).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"grp", "label", "item", "big", "new_split"}
    off = {}
    for r in got:
        own = off.setdefault(r["label"], [0, 0])
        own[r["new_split"] == "train"] += 1
    if labels == 5:
        assert all(abs(a / (a + b) - 0.5) < 0.05 for k, (a, b) in off.items() if k)
    assert sum((a - b) ** 2 / (a + b) for a, b in off.values()) < 2.5 * len(rows) / labels * len(off) / 10


def test_hot_entities_are_salted(spark, monkeypatch):
    segments, links = split_input(spark)
    held = lambda: {r["seg_row"]: r["person"] for r in entity_splits.with_groups(segments, "speaker_id", links, "speaker_id", "same_as", "link_id", F.col("id"), "person").collect()}
    small = held()
    monkeypatch.setattr(entity_splits, "BROADCAST_BYTES", -1)
    assert held() == small and len(small) == segments.count()


def test_splits_of_nothing(spark):
    segments, links = split_input(spark, 3)
    targets = spark.createDataFrame([("train", 1.0)], "split string, target_share double")
    grouped = entity_splits.with_groups(segments.limit(0), "speaker_id", links.limit(0), "speaker_id", "same_as", "link_id", F.col("id"), "person")
    assert entity_splits.grouped_split(grouped, "person", "source", targets).count() == 0
    with pytest.raises(ValueError):
        entity_splits.grouped_split(grouped, "person", "source", targets.limit(0))


# oversized items ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        (None, []), ("", []), ("One.", []), ("One. Two.", ["One."]), ("Mr. Bo left. He ran.", ["Mr. Bo left."]), ("At 3 a.m. the dog ran. It ran.", ["At 3 a.m. the dog ran."]),
        ("See No. 12 now. No. Yes.", ["See No. 12 now.", "See No. 12 now. No."]), ('"Is it?" asked Bo. Yes.', ['"Is it?" asked Bo.']), ('He said, "Go." She went.', ['He said, "Go."']), ("(It rained.) We left.", ["(It rained.)"]),
        ("the road.Who ran? Bo.", ["the road.", "the road.Who ran?"]), ("well ... it ran. Ok.", ["well ... it ran."]), ("Pi is 3.14 today. Ok.", ["Pi is 3.14 today."]), ("J. R. Bo and P. Cro, Jr., ran. Ok.", ["J. R. Bo and P. Cro, Jr., ran."]),
        ("The U.S. rule, i.e. this, holds. Ok.", ["The U.S. rule, i.e. this, holds."]), ("Bo Inc. sold it. Ok.", ["Bo Inc. sold it."]), ("He works at Bo Inc. The dog ran.", ["He works at Bo Inc."]), ("Bo v. Cro holds. Ok.", ["Bo v. Cro holds."]),
        ("“We ran,” Ms. Bo wrote, “and hid.” Ok.", ["“We ran,” Ms. Bo wrote, “and hid.”"]), ("the dog. \"Is it?\" asked Bo. Ok", ["the dog.", 'the dog. "Is it?" asked Bo.']), ('the dog."Is it?" asked Bo. Ok', ["the dog.", 'the dog."Is it?" asked Bo.']), ("見た。それ。", ["見た。"]),
        ("What?! No... Yes", ["What?!", "What?! No..."]), ("the shore.Mr. Bo ran. Ok", ["the shore.", "the shore.Mr. Bo ran."]), ("...", []), ("a\tb.  C d.", ["a\tb."]),
    ],
)
def test_sentence_ends(text, ends):
    assert [text[:e] for e in oversized.sentence_ends(text)] == ends


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,?!\n\"é漢", max_size=300), st.floats(0.5, 500), st.floats(0.4, 40), st.floats(0, 50))
def test_pieces_hold_their_limits(text, length, limit, overlap):
    got = oversized.pieces_of(text, length, limit, overlap)
    assert got[0][1] == 0 and got[-1][2] == pytest.approx(length)
    if length <= limit:
        assert got == [(text, 0.0, length, oversized.sentence_ends(text))]
        return
    shared = min(max(overlap, 0), limit / 2)
    for _, a, b, _ in got:
        assert b - a <= limit + 1e-6 and b > a
    assert [e for p in got for e in p[3]] == oversized.sentence_ends(text)
    for (_, _, end, _), (_, start, _, _) in zip(got, got[1:], strict=False):
        assert end - start == pytest.approx(shared, abs=1e-6)
    assert len(got) >= math.ceil((length - shared) / (limit - shared) - 1e-6)


def test_very_long_text_is_cut_quickly():
    text = "The dog ran home. " * 20_000
    got = oversized.pieces_of(text, 20_000.0, 25.0, 1.0)
    assert all(p[0].endswith("home.") for p in got) and len(got) < 1000


def test_oversized_records(spark):
    long = "The dog ran home. The cat sat down. It was late, and we left. So it went on."
    rows = [(1, "a", 1, long, 30.0, 100.0, 130.0), (2, "a", 1, long, 30.0, 100.0, 130.0), (3, "b", 1, long, 30.0, None, 5.0), (4, "c", 1, long, 30.0, 9.0, 5.0), (5, "d", 1, None, None, 0.0, 40.0), (6, "e", 9, long, 99.0, None, None)]
    rows += [(7, "f", None, long, 99.0, None, None), (8, "g", 1, long, NAN, None, None), (9, "h", 1, long, INF, None, None), (10, "i", 1, "", 33.0, None, None), (11, None, 1, long, 33.0, None, None), (12, "j", 1, long, 10.0, None, None), (13, "k", 2, long, 99.0, None, None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "seg_row long, id string, source int, text_original string, duration_s double, start_s double, end_s double, limit int, piece string")
    sources = spark.createDataFrame([(1, 1.0, 1, 1, "s", 10.0, 2.0), (2, 1.0, 1, 1, "s", None, None), (None, 1.0, 1, 1, "s", 1.0, 0.0)], SOURCES)
    found = {}
    for r in oversized.record_boundaries(df, sources).collect():
        found.setdefault(r["id"], []).append(r["char_pos"])
    assert {k: sorted(v) for k, v in found.items()} == dict.fromkeys("abh", [17, 35, 61])
    pieces = {}
    for r in oversized.split_oversized(df, sources).collect():
        pieces.setdefault(r["id"], []).append(r)
    assert set(pieces) == set("abdhi")
    for k in "abdi":
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(own[0]["n_pieces"]))
        assert all(0 < r["end_s"] - r["start_s"] <= 10 + 1e-6 for r in own)
    assert min(r["start_s"] for r in pieces["a"]) == 100 and max(r["end_s"] for r in pieces["a"]) == 130
    assert all(r["text"] is None for r in pieces["d"]) and all(r["text"] == "" for r in pieces["i"])
    assert len(pieces["h"]) == 4 and all(r["start_s"] is None for r in pieces["h"])
    assert oversized.split_oversized(df.limit(0), sources).count() == 0 and oversized.record_boundaries(df, sources.limit(0)).count() == 0


# cutoffs ------------------------------------------------------------------------------------------

BETTER = {"low": "low", "high": "high"}


def cutoff_input(spark, n=4000):
    rng = random.Random(5)
    rows = [(f"a{i}", 1, round(rng.gauss(0, 1), 2), -99.0) for i in range(n)] + [(f"b{i}", 2, -99.0, float(rng.randrange(5))) for i in range(500)] + [("c", 3, 7.0, 7.0)]
    rows += [rows[i] for i in range(0, n, 3)] + [("n1", 1, NAN, 0.0), ("n2", 1, INF, 0.0), ("n3", 1, None, 0.0), ("n4", 1, -INF, 0.0), (None, 1, 0.0, 0.0), ("n5", None, 0.0, 0.0), ("n6", 77, 0.0, 0.0)]
    sources = [(1, 1.0, 1, 37, "low", 1.0, 0.0), (2, 1.0, 1, 55, "high", 1.0, 0.0), (3, 1.0, 1, 50, "low", 1.0, 0.0), (4, 1.0, 1, 50, "low", 1.0, 0.0)]
    df = spark.createDataFrame([(*r, 1.5, "z") for r in rows], "id string, source int, low double, high double, badness double, n string")
    return df, spark.createDataFrame(sources, SOURCES), rows


@pytest.mark.parametrize("look", [200_000, 10])
def test_cutoffs_are_exact_with_ties(spark, monkeypatch, look):
    monkeypatch.setattr(cutoffs, "LOOK", look)
    df, sources, rows = cutoff_input(spark)
    records = cutoffs.cut(cutoffs.scored_records(df, sources, BETTER))
    got = {r["source"]: r for r in cutoffs.cutoffs(records, sources, BETTER).collect()}
    for s, pct, at, sign in ((1, 37, 2, 1), (2, 55, 3, -1), (3, 50, 2, 1)):
        own = sorted({r[0]: sign * r[at] for r in rows if r[1] == s and r[0] and r[at] is not None and math.isfinite(r[at])}.values())
        k = -(-len(own) * pct // 100)
        r = got[s]
        assert (r["n"], r["k"], r["cutoff"]) == (len(own), k, sign * own[k - 1])
        assert r["n_kept"] == sum(x <= own[k - 1] for x in own) and r["n_ties"] == own.count(own[k - 1])
    assert set(got) == {1, 2, 3}
    beyond = {r["id"] for r in cutoffs.beyond_cutoff(df, sources, BETTER).collect()}
    want = {r[0] for r in rows if r[1] == 1 and r[0] and r[2] is not None and math.isfinite(r[2]) and r[2] > got[1]["cutoff"]} | {r[0] for r in rows if r[1] == 2 and r[3] < got[2]["cutoff"]}
    assert beyond == want


def test_cutoffs_by_halves(spark, monkeypatch):
    """Where no sketch narrows a bracket, halving does, down to ties that exceed the look."""
    monkeypatch.setattr(cutoffs, "LOOK", 3)
    monkeypatch.setattr(cutoffs, "RANK_ERROR", 2.0)
    rng = random.Random(8)
    rows = [(f"{s}{i}", s, float(rng.choice([rng.gauss(0, 1e6), 0.5, 0.5, -7.0, 1e-300]))) for s in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, source int, badness double")
    got = cutoffs.kth_best(df, {1: 100, 2: 299})
    for s, k in ((1, 100), (2, 299)):
        own = sorted(b for _, x, b in rows if x == s)
        assert got[s] == (own[k - 1], sum(b < own[k - 1] for b in own), own.count(own[k - 1]))


def test_cutoffs_at_the_ends(spark):
    df, sources, _ = cutoff_input(spark, 50)
    for pct, kept in ((0, 0), (100, 50), (None, 50), (-5, 0), (300, 50)):
        own = sources.where("source = 1").withColumn("keep_pct", F.lit(pct).cast("int"))
        records = cutoffs.cut(cutoffs.scored_records(df, own, BETTER))
        assert cutoffs.cutoffs(records, own, BETTER).first()["n_kept"] == kept
        assert cutoffs.beyond_cutoff(df, own, BETTER).count() == 50 - kept
    assert cutoffs.beyond_cutoff(df.limit(0), sources, BETTER).count() == 0


# tokens -------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def encoder():
    return tokens.Encoder(tokens.vocabulary())


@pytest.fixture(scope="session")
def public(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abcdefghij  \n\t'.=!09éß漢😀Ä"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS, more=TEXTS, at=st.integers(0, 80), size=st.integers(0, 20))
def test_encoding_appends_and_edits(encoder, public, text, more, at, size):
    assert encoder.encode(text) == public.encode_ordinary(text)
    assert encoder.count(text) == len(encoder.encode(text))
    held = tokens.Prefixes(encoder, text).append(more)
    assert held.ids == public.encode_ordinary(text + more)
    a = min(at, len(held.text))
    b = min(a + size, len(held.text))
    held.edit(a, b, text[:7])
    assert held.ids == public.encode_ordinary(held.text)


def test_other_library_and_special_spellings(encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("<|endoftext|> is text", "Hello,  world\n\n\n x", "don't we'll I'M", "a" * 3000, "=" * 500 + " " * 700, "​﻿\x00"):
        assert encoder.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_corpus_encoding(spark, encoder):
    df = spark.createDataFrame([(1, "Hello world", [9]), (2, "", None), (3, None, None), (3, "Hello world", None)], "doc_id long, text string, ids array<int>")
    got = tokens.encode_corpus(df).select("doc_id", "text", "ids").collect()
    assert len(got) == 4 and all(r["ids"] == encoder.encode(r["text"]) for r in got)
    assert dict(tokens.encode_corpus(df).dtypes)["ids"] == "array<int>" and tokens.encode_corpus(df.limit(0)).count() == 0


# packing ------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=7), st.integers(0, 40))
def test_fullest_equals_brute_force(counts, room):
    got = packing.fullest(counts, room)
    assert all(0 < n <= counts[x] for x, n in got.items())
    sums = {0}
    for x, n in counts.items():
        sums = {s + i * x for s in sums for i in range(n + 1)}
    assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50)))
def test_plans_place_every_item_once(counts):
    placed: dict = {}
    bins = 0
    for mix, n in packing.plan_bins(counts, 20):
        assert n > 0 and sum(x * k for x, k in mix.items()) <= 20
        bins += n
        for x, k in mix.items():
            placed[x] = placed.get(x, 0) + k * n
    assert placed == counts
    assert bins >= -(-sum(x * n for x, n in counts.items()) // 20)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, rng.choice([5, 7, 60, 100, 33, 250])) for i in range(400)] + [(1000, 0), (1001, None), (1002, -4), (None, 9), (7, 9)]
    got = packing.pack(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, n_tokens int, bin string, n int"), "doc_id", "n_tokens", 100).collect()
    bins: dict = {}
    for r in got:
        bins.setdefault(r["bin"], []).append(r)
    assert set(bins) == set(range(len(bins)))
    for own in bins.values():
        spans = sorted((r["place"], r["place"] + r["n"]) for r in own)
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    want = sorted([(i, n) for i, n in rows if n and n > 0], key=str)
    whole: dict = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n"]))
    for i, n in want:
        if i is not None and i != 7:
            pieces = sorted(whole[i])
            assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == [100 * j for j in range(len(pieces))] and (n > 100) == (len(pieces) > 1)
    assert sum(r["n"] for r in got) == sum(n for _, n in want)
    assert len(bins) <= -(-sum(r["n"] for r in got) // 100) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), "doc_id", "n_tokens").count() == 0


# reading level ------------------------------------------------------------------------------------


def graded(rng, level):
    small, large = ["dog", "cat", "sun", "box", "hat"], ["constitution", "jurisdiction", "epistemology", "interpretation", "proportionality"]
    words = lambda n, share: " ".join(rng.choice(large if rng.random() < share else small) for _ in range(n))
    size, share = {1: (4, 0.0), 2: (9, 0.15), 3: (14, 0.4), 4: (26, 0.8)}[level]
    return " ".join(f"The {words(size, share)} and the {words(2, share)}." for _ in range(8))


def test_levels_are_learnt(spark):
    rng = random.Random(4)
    rows = [(i, graded(rng, i % 4 + 1), i % 4 + 1) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "zz", 3) for i, t, _ in rows] + [(900, None, "en", 1), (901, "", "en", 1), (902, "Der Hund und die Katze und das Haus sind nicht hier und der Mann auch nicht.", "en", 1), (903, "12 34 56", "en", 1)], "doc_id long, text string, lang string, level int")
    labels = spark.createDataFrame([(i, min(4, max(1, y + (i % 20 == 7)))) for i, _, y in rows[:240]] + [(0, None), (5000, 2), (None, 1), (1, 2)], "doc_id long, reading_level int")
    got = {r["doc_id"]: r for r in reading_level.reading_levels(docs, labels).collect()}
    assert len(got) == 404
    held = rows[240:]
    assert sum(got[i]["level"] == y for i, _, y in held) / len(held) > 0.9
    assert all(got[i]["english"] for i, *_ in rows)
    for k in (900, 901, 903):
        assert got[k]["n_words"] == 0 and got[k]["level"] is None and not got[k]["english"]
    assert not got[902]["english"] and got[902]["n_words"] == 16
    loud = spark.createDataFrame([(i, "<p>JUSTICE BRAFORD: " + t.upper() + "</p> © [tape 3/12]") for i, t, _ in rows[:40]], "doc_id long, text string")
    same = {r["doc_id"]: r["level"] for r in reading_level.reading_levels(docs.select("doc_id", "text").where("doc_id >= 40").union(loud), labels).collect()}
    assert sum(same[i] == got[i]["level"] for i in range(40)) >= 38


def test_markup_and_entities_dont_count():
    a = 'They said "yes, now", and left; it was late. We ran home.'
    for b in (a.replace('"', "&quot;"), f"<p>{a}</p>", f'<a href="x" title="{"long " * 200}">{a}</a>', a + " [" + "tape, side; two " * 30 + "]"):
        assert reading_level.features(a, {}) == reading_level.features(b, {})


def test_languages_are_told_by_letters(spark):
    rng = random.Random(6)
    english = "the dog ran along the shore and the cat sat under a tree while we were at home with that old box".split()
    german = "der hund lief am ufer entlang und die katze sass unter einem baum als wir zu hause waren mit dem kasten".split()
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, say(english, 40), "EN " if i % 3 else None) for i in range(200)] + [(1000 + i, say(german, 40), "de" if i % 10 else "en") for i in range(100)]
    rows += [(2000 + i, "".join(rng.choice("qzxkvjw mnbp") for _ in range(200)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 4 + 1) for i in range(0, 100)], "doc_id long, reading_level int")
    for lang in ("lang", None):
        got = {r["doc_id"]: r["english"] for r in reading_level.reading_levels(docs, labels, lang=lang).collect()}
        assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(100)) and not any(got[2000 + i] for i in range(10))


def test_levels_without_labels(spark):
    docs = spark.createDataFrame([(1, "The dog and the cat.")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, reading_level int")
    assert reading_level.reading_levels(docs, labels).first()["level"] is None
    assert reading_level.reading_levels(docs.limit(0), labels).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(1, 4)), min_size=1, max_size=30))
def test_isotonic_is_monotone_and_fits_means(points):
    score, y = np.array([float(a) for a, _ in points]), np.array([float(b) for _, b in points])
    xs, ys = reading_level.isotonic(score, y)
    assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) >= 0).all()
    fitted = np.interp(score, xs, ys)
    assert fitted.sum() == pytest.approx(y.sum())


def test_layout_doesnt_count():
    plain = "Although the dog ran, the cat sat. We left the house."
    wrapped = "MR. BRAFORD: Although the dog\nran, the cat sat. We left\nthe house. [tape 3/12]"
    assert reading_level.sentences(reading_level.plain(plain)) == reading_level.sentences(reading_level.plain(wrapped))
    assert reading_level.sentences("The dog ran\nThe cat sat") == [["the", "dog", "ran"], ["the", "cat", "sat"]]
    assert reading_level.sentences("") == []


def test_habits_of_a_corpus(spark):
    """An abbreviation that no list holds, and first words that the corpus writes small, decide where the lists are silent."""
    texts = ["We saw abt. ten ships and glimmering lights."] * 6 + ["They were abt. half done, glimmering lights or not, said Zorro."] * 4 + ["Ships came, and Zorro left. Glimmering lights shone."] * 6 + [None, ""]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, word string")
    habits = oversized.learn_habits(df)
    assert "abt" in habits.stopped and "glimmering" in habits.small and "zorro" in habits.names
    text = "It cost abt. Zorro knew. He met Mr. Bo Inc. Glimmering ships. We met Ada Inc. Zorro too."
    ends = lambda h: [text[:e].split()[-1] for e in oversized.sentence_ends(text, h)]
    assert ends(None) == ["abt.", "knew.", "ships."]
    assert ends(habits) == ["knew.", "Inc.", "ships."]
    none = oversized.learn_habits(df.limit(0))
    assert not none.small and not none.stopped


def test_targets_are_balanced():
    """Ends of sentences stand beside the start and the end alone; the piece is cut at the comma nearest its middle."""
    text = "Yes. " + "the dog ran along the shore, " * 40 + "and home. Ok"
    got = oversized.pieces_of(text, 90.0, 89.9, 0.5)
    assert len(got) == 2 and got[0][0].endswith("shore,")
    sizes = [b - a for _, a, b, _ in got]
    assert min(sizes) / max(sizes) > 0.95


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(4, 60), min_size=2, max_size=60), st.integers(40, 400), st.integers(0, 40))
def test_snapped_pieces_are_balanced(sizes, limit, overlap):
    text = " ".join("A" + "b" * (n - 3) + "." for n in sizes)
    length, overlap = float(len(text)), float(min(overlap, limit // 2))
    if length <= limit:
        return
    bounds = oversized.boundaries(text)
    cuts = oversized._snapped(bounds, len(text), length, float(limit), overlap)
    at = [overlap, *(c[1] for c in cuts), length]
    step = (length - overlap) / (len(cuts) + 1)
    for k, c in enumerate(cuts, 1):
        target = overlap + k * step
        assert c[1] <= target + oversized.NEAR * step + 1e-6
        near = [(p, s) for p, s in bounds if abs(p - target) <= oversized.NEAR * step - 1e-6 and p <= at[k - 1] - overlap + limit]
        assert not near or c[2] >= max(s for _, s in near)
    steps = [b - a for a, b in zip(at, at[1:], strict=False)]
    assert all(x + overlap <= limit + 1e-6 for x in steps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(2, 60), st.booleans()), min_size=2, max_size=9), st.integers(10, 90), st.integers(0, 20))
def test_weighed_cuts_equal_brute_force(parts, limit, overlap):
    import itertools

    at, bounds = 0, []
    for n, strong in parts:
        at += n
        bounds.append((at, 3 if strong else 1))
    size, bounds, overlap = at, bounds[:-1], min(overlap, limit // 2)
    best = None
    for r in range(len(bounds) + 1):
        for own in itertools.combinations(bounds, r):
            points = [0, *(p for p, _ in own), size]
            steps = [b - a for a, b in zip(points, points[1:], strict=False)]
            if min(steps) < oversized.SHORTEST * limit or steps[0] > limit or any(x + overlap > limit for x in steps[1:]):
                continue
            cost = (sum(s < 3 for _, s in own), len(own), sum(x * x for x in steps))
            best = cost if best is None else min(best, cost)
    got = oversized._weighed(bounds, size, float(size), float(limit), float(overlap))
    if best is None:
        assert got is None
        return
    points = [0, *(c[0] for c in got), size]
    assert (sum(c[2] < 3 for c in got), len(got), sum((b - a) ** 2 for a, b in zip(points, points[1:], strict=False))) == best


def test_long_words_and_hostile_marks_end():
    word = "W" + "o" * 200
    assert oversized.sentence_ends(f"the {word.lower()}.The dog ran. Ok") == [len(word) + 5, len(word) + 17]
    for text in ("a." * 20_000, "x" * 50_000 + ". Y", ". " * 20_000, "?!" * 20_000, '"' * 20_000 + ". A"):
        assert isinstance(oversized.sentence_ends(text), list)


def test_every_sentence_its_own_piece():
    text = "".join("a" * 288 + ". " + "B" * 18 + ". " for _ in range(8))[:-1]
    text = "".join(x[0].upper() + x[1:] for x in re.split(r"(?<=\. )", text))
    got = oversized.pieces_of(text, len(text) / 10, 30.0, 0.0)
    assert all(p[0].endswith(".") for p in got)
