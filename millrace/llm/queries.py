"""Queries of the operators for language-model training data, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cutoffs, entity_splits, mixing, oversized, packing, reading_level, tokens
from millrace.session import bounded_rows, read_table, spread

BETTER = {"ctc_mismatch": "low", "avg_word_score": "high"}


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segments = read_table(spark, sf_dir, "segments").select("id", "source", "duration_s")
    return mixing.mix(segments, read_table(spark, sf_dir, "mixture_sources"), "duration_s")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their share."""
    segments = read_table(spark, sf_dir, "segments").select("id", "source", "duration_s")
    return mixing.short_of_share(segments, read_table(spark, sf_dir, "mixture_sources"), "duration_s")


def p2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture with their number of copies."""
    return _mix(spark, sf_dir)[0]


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of the sources."""
    return _mix(spark, sf_dir)[1]


def _persons(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    segments = read_table(spark, sf_dir, "segments").select("seg_row", "id", "speaker_id", *columns)
    key = F.coalesce("id", F.concat(F.lit("row "), F.col("seg_row").cast("string")))
    return entity_splits.with_groups(segments, "speaker_id", read_table(spark, sf_dir, "speaker_links"), "speaker_id", "same_as", "link_id", key, "person")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons whose segments lie in more than one split today."""
    bounded_rows(read_table(spark, sf_dir, "split_names"), 10_000, "split_names")
    names = read_table(spark, sf_dir, "split_names").where("split in ('train', 'validation', 'test')").select("split_raw", F.expr("case split when 'train' then 1 when 'validation' then 2 else 4 end").alias("bit")).dropDuplicates(["split_raw"])
    segments = read_table(spark, sf_dir, "segments").select("seg_row", "speaker_id", "split")
    bits = segments.join(F.broadcast(names), segments["split"] == names["split_raw"], "left")
    # rows shrink to one per spelling before they meet the components
    by_id = bits.groupBy("speaker_id").agg(F.min("seg_row").alias("first"), F.bit_or(F.coalesce("bit", F.lit(0))).alias("bits"))
    by_id = by_id.where(entity_splits.entity_key(F.col("speaker_id")).isNotNull())
    persons = entity_splits.with_groups(by_id, "speaker_id", read_table(spark, sf_dir, "speaker_links"), "speaker_id", "same_as", "link_id", F.col("speaker_id"), "person")
    found = persons.groupBy("person").agg(F.min("first").alias("first_seg_row"), F.bit_or("bits").alias("bits"))
    return found.where(F.bit_count("bits") >= 2).select("first_seg_row")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every segment; a person's segments share it, and so do deliveries of a record that names nobody."""
    return entity_splits.grouped_split(_persons(spark, sf_dir, "source"), "person", "source", read_table(spark, sf_dir, "split_targets")).select("seg_row", "person", "source", "new_split")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, persons and share of each split by source."""
    rows = p3_splits(spark, sf_dir).groupBy("source", "new_split").agg(F.count("*").alias("n_rows"), F.countDistinct("person").alias("n_persons"))
    whole = rows.groupBy(F.col("source").alias("s")).agg(F.sum("n_rows").alias("n"))
    return rows.join(whole, rows["source"].eqNullSafe(whole["s"])).select("source", "new_split", "n_rows", "n_persons", (F.col("n_rows") / F.col("n")).alias("share"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sentences end inside oversized records."""
    return oversized.record_boundaries(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "mixture_sources"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the oversized records."""
    return oversized.split_oversized(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "mixture_sources")).drop("sentence_ends")


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each oversized record cover: from where to where, the seconds without what they share, and whether all hold the limit and share the overlap."""
    sources = read_table(spark, sf_dir, "mixture_sources")
    pieces = p4_pieces(spark, sf_dir).where("start_s is not null")
    records = oversized.oversized_records(read_table(spark, sf_dir, "segments").drop("text_original").withColumn("text_original", F.lit("")), sources).select(F.col("id").alias("i"), "limit", F.least(F.greatest("overlap", F.lit(0.0)), F.col("limit") / 2).alias("overlap"))
    ends = F.sort_array(F.collect_list(F.struct("piece", "start_s", "end_s")))
    by = pieces.groupBy("id").agg(F.count("*").alias("n"), ends.alias("e")).join(records, F.col("id") == F.col("i"))
    holds = F.forall("e", lambda x: x["end_s"] - x["start_s"] <= F.col("limit") + 1e-6)
    shares = F.forall(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: (i == 1) | (F.abs(F.try_element_at("e", i - F.when(i > 1, 1).otherwise(0))["end_s"] - F.try_element_at("e", i)["start_s"] - F.col("overlap")) < 1e-6))
    covered = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["end_s"] - x["start_s"]) - (F.col("n") - 1) * F.col("overlap")
    return by.select("id", F.round(F.element_at("e", 1)["start_s"], 3).alias("begins"), F.round(F.element_at("e", -1)["end_s"], 3).alias("ends"), F.round(covered, 3).alias("covered"), (holds & shares & (F.col("n") > 1)).alias("holds"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beyond their source's cutoff."""
    return cutoffs.beyond_cutoff(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "mixture_sources"), BETTER).select("id")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff, kept records and ties of each source."""
    sources = read_table(spark, sf_dir, "mixture_sources")
    records = cutoffs.cut(cutoffs.scored_records(read_table(spark, sf_dir, "segments"), sources, BETTER))
    return cutoffs.cutoffs(records, sources, BETTER).drop("badness_cutoff")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(_texts(spark, sf_dir)).select("doc_id", "ids")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters by language."""
    documents = spread(read_table(spark, sf_dir, "documents").select("lang", "text"))
    counted = documents.select("lang", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), tokens.count_column(spark, F.col("text")).alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum("chars").alias("n_chars"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _texts(spark, sf_dir)
    return packing.pack(documents.select("doc_id", tokens.count_column(spark, F.col("text")).alias("n_tokens")), "doc_id", "n_tokens", 1024)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: those with a second piece."""
    return _packed(spark, sf_dir).where("piece = 1").select("doc_id")


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of each document or piece."""
    return _packed(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, tokens, and the share left empty."""
    filled = _packed(spark, sf_dir).groupBy("bin").agg(F.sum("n").alias("n"))
    return filled.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.count_if(F.col("n") == 1024).alias("n_full"), (1 - F.sum("n") / (F.count("*") * 1024)).alias("empty_share"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    return reading_level.reading_levels(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), read_table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of at least 40 words at level 4."""
    return p8_levels(spark, sf_dir).where("english and n_words >= 40 and level = 4").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_mixture, p2_report, p3_found, p3_splits, p3_report, p4_found, p4_pieces, p4_cover, p5_found, p5_cutoffs, p6_ids, p6_profile, p7_found, p7_sequences, p7_report, p8_found, p8_levels)}

_KEY = r"lower(upper(regexp_replace({0}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g')))"


def _key(c: str) -> str:
    key = _KEY.format(c)
    return f"case when {key} <> '' and not regexp_matches({key}, '(^|:)unknown$') then {key} end"


ORACLES = {
    "p2_found": """
        with r as (select s.id, s.source, min(s.duration_s) d from segments s join mixture_sources m using (source)
                   where m.weight is not null and not isnan(m.weight) and s.id is not null and isfinite(s.duration_s) and s.duration_s > 0 group by all),
             t as (select source, sum(d) s from r group by 1),
             w as (select source, weight, max_repeats from mixture_sources where weight is not null and not isnan(weight))
        select w.source from w left join t using (source)
        where coalesce(max_repeats, 1) * coalesce(s, 0) < weight / (select sum(weight) from w) * (select sum(s) from t)""",
    "p3_found": f"""
        with recursive e as (select distinct {_key("speaker_id")} a, {_key("same_as")} b from speaker_links),
             edge as (select a, b from e where a is not null and b is not null union select b, a from e where a is not null and b is not null),
             reach as (select a, a as b from edge union select r.a, edge.b from reach r join edge on r.b = edge.a),
             comp as (select a, min(b) c from reach group by 1),
             seg as (select seg_row, {_key("speaker_id")} k, n.split from segments left join split_names n on segments.split = n.split_raw)
        select min(seg_row) as first_seg_row from seg left join comp on seg.k = comp.a where k is not null
        group by coalesce(c, k) having count(distinct seg.split) filter (seg.split in ('train', 'validation', 'test')) >= 2""",
    "p5_cutoffs": """
        with r as (select id, s.source, score_field, min(case score_field when 'ctc_mismatch' then ctc_mismatch when 'avg_word_score' then -avg_word_score end) b
                   from segments s join mixture_sources m using (source) where id is not null
                   and isfinite(case score_field when 'ctc_mismatch' then ctc_mismatch when 'avg_word_score' then avg_word_score end) group by all),
             n as (select source, count(*) as n, coalesce(any_value(keep_pct), 100) as pct from r join mixture_sources using (source) group by source),
             o as (select r.*, n, pct, (n * pct + 99) // 100 as k, row_number() over (partition by source order by b) rn from r join n using (source)),
             c as (select source, b as cut from o where rn = k)
        select source, any_value(score_field) as score_field, any_value(n) as n, any_value(pct) as keep_pct, any_value(k) as k,
               any_value(case score_field when 'ctc_mismatch' then cut else -cut end) as cutoff, count(*) filter (b <= cut) as n_kept, count(*) filter (b = cut) as n_ties,
               count(*) filter (b <= cut) / any_value(n) as kept_share from o join c using (source) group by source""",
    "p4_cover": """
        with m as (select source, max_segment_seconds as lim from mixture_sources where source is not null and max_segment_seconds > 0 and not isnan(max_segment_seconds)),
             r as (select id, seg_row, case when end_s is null or start_s is null then 0 else start_s end as b,
                          case when start_s is null or end_s is null then duration_s else end_s - start_s end as l, lim from segments join m using (source) where id is not null),
             o as (select id, arg_min(b, seg_row) as b, arg_min(l, seg_row) as l from r where l is not null and not isnan(l) and l > lim group by id)
        select id, round(b, 3) as begins, round(b + l, 3) as ends, round(l, 3) as covered, true as holds from o where not isinf(l)""",
    "p5_found": """
        with r as (select id, s.source, min(case score_field when 'ctc_mismatch' then ctc_mismatch when 'avg_word_score' then -avg_word_score end) b
                   from segments s join mixture_sources m using (source) where id is not null
                   and isfinite(case score_field when 'ctc_mismatch' then ctc_mismatch when 'avg_word_score' then avg_word_score end) group by all),
             n as (select source, (count(*) * coalesce(keep_pct, 100) + 99) // 100 as k from r join mixture_sources using (source) group by source, keep_pct),
             o as (select *, row_number() over (partition by source order by b) rn from r),
             c as (select o.source, o.b as cutoff from o join n on o.source = n.source and o.rn = n.k)
        select r.id from r join c using (source) where r.b > c.cutoff""",
}
