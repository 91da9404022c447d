"""Queries of projections, filters, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import columns as P
from millrace.operators import filters as Fi
from millrace.operators import joins as J
from millrace.operators import sets as U
from millrace.operators import windows as Wn
from millrace.queries import WHITE, Registry, sql_strip
from millrace.session import broadcast_if_small, read_table, spread

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

LEVELS = "select doc_id, min(reading_level) as level, count(*) as n_labels from reading_labels group by doc_id"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "reading_labels").groupBy("doc_id").agg(F.min("reading_level").alias("level"), F.count("*").alias("n_labels"))


@query(f"""
    with d as (select * from documents where lower({sql_strip("lang")}) in ('en', 'de') and n_chars > 50 and n_chars < 5000),
         f as (select *, row_number() over (partition by text order by doc_id) rn from d),
         j as (select f.lang, l.level, f.n_chars from f left join ({LEVELS}) l using (doc_id) where rn = 1)
    select lower(lang) as lang, level, count(*) as n_docs, cast(sum(n_chars) as bigint) as n_chars from j group by all""")
def flagship_curation(spark: SparkSession, d: str) -> DataFrame:
    """Language and length filters, first occurrence of each text, label lookup, grouped statistics."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    kept = Fi.prune_range(Fi.prune_matching(docs, ["lang"], ["en", "de"]), ["n_chars"], 50, 5000)
    one = Wn.first_occurrence(kept, "text", ["doc_id"])
    rated = J.join_lookup(one, _levels(spark, d), "doc_id", ["level"])
    return rated.groupBy(F.lower("lang").alias("lang"), "level").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("select cast(o_orderkey as varchar) as order_id, o_custkey as customer, cast(o_orderdate as date) as o_orderdate from orders")
def select_rename_cast_drop(spark: SparkSession, d: str) -> DataFrame:
    """Projection, casts, renames and a dropped column."""
    orders = P.select_columns(read_table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])
    cast = P.cast_columns(orders, {"o_orderkey": "string", "o_orderdate": "date", "o_orderstatus": None})
    return P.rename_columns(cast, {"o_orderkey": "order_id", "o_custkey": "customer"})


@query("select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def remove_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns removed by name."""
    return P.remove_columns(read_table(spark, d, "customer"), ["c_acctbal"])


@query("""select event_id, nullif(trim(json_extract_string(props, '$.k')), '') as k, json_extract_string(props, '$.none') as absent from events""")
def json_path_extract(spark: SparkSession, d: str) -> DataFrame:
    """JSON paths of a text column."""
    return P.extract_nested(read_table(spark, d, "events").select("event_id", "props"), "props", [("$.k", "k"), ("$.none", "absent")])


@query("select seg_row, nullif(trim(audio.path), '') as audio_path from segments")
def struct_path_extract(spark: SparkSession, d: str) -> DataFrame:
    """A path of a struct column, which is dropped."""
    return P.extract_nested(read_table(spark, d, "segments").select("seg_row", F.struct(F.col("audio.path").alias("path")).alias("audio")), "audio", [("$.path", "audio_path")])


@query("select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as row from documents")
def row_index_per_split(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers from 0 in each split."""
    return P.assign_row_index(read_table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], "lang")


@query("""select o_orderkey, case when case when o_orderstatus = 'O' then 'open' else o_orderstatus end = 'open' and true then '0-NONE'
    else case when o_orderkey = 1 then 'first' else o_orderpriority end end as o_orderpriority, case when o_orderstatus = 'O' then 'open' else o_orderstatus end as o_orderstatus from orders""")
def value_override_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules in order; the last sees what the first wrote."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.override_values(orders, [("o_orderstatus", "O", "o_orderstatus", "open"), ("o_orderkey", 1, "o_orderpriority", "first"), ("o_orderstatus", "open", "o_orderpriority", "0-NONE")])


@query("select seg_row, concat_ws(':', coalesce(docket, 'None'), coalesce(cast(source as varchar), 'None'), coalesce(cast(date_argued as varchar), 'None')) as id from segments")
def composite_id(spark: SparkSession, d: str) -> DataFrame:
    """An id from several columns, nulls as text."""
    return P.composite_id(read_table(spark, d, "segments").select("seg_row", "docket", "source", "date_argued"), ["docket", "source", "date_argued"]).select("seg_row", "id")


@query(f"""with c as (select meta_row, {sql_strip("description")} a, {sql_strip("title")} b from media_metadata)
    select meta_row, case when length(a) >= 12 then a when length(b) >= 12 then b end as caption, case when length(a) >= 12 then 'description' when length(b) >= 12 then 'title' end as caption_source from c""")
def caption_select(spark: SparkSession, d: str) -> DataFrame:
    """The first usable caption and its column."""
    return P.select_caption(read_table(spark, d, "media_metadata"), ["description", "title"], min_characters=12).select("meta_row", "caption", "caption_source")


@query("select doc_id, n_chars * 2 as double_chars, length(text) as chars from documents where n_chars is not null and text is not null")
def null_output_filter(spark: SparkSession, d: str) -> DataFrame:
    """Mapped columns; rows with a null among them go, other nulls stay."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    out = P.map_columns(docs, {"double_chars": F.col("n_chars") * 2, "chars": F.char_length("text").cast("long")}, ["text", "lang", "n_chars"], filter_null_outputs=True)
    return out


@query(f"select doc_id, lang from documents where lower({sql_strip('lang')}) in ('en', 'fr')")
def match_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows that match one of several values."""
    return Fi.prune_matching(read_table(spark, d, "documents").select("doc_id", "lang"), ["lang"], [" EN ", "fr"])


@query(f"select doc_id, lang from documents where lang is null or lower({sql_strip('lang')}) not in ('en')")
def nmatch_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows that don't match; nulls stay."""
    return Fi.prune_matching(read_table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["en"], negate=True, prune_nulls=False)


@query("select p_partkey from part where contains(lower(p_name), 'a') or contains(lower(p_type), 'a')")
def any_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which any column holds a text."""
    return Fi.prune_matching(read_table(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], ["A"], containing=True).select("p_partkey")


@query("select p_partkey from part where not contains(p_brand, '1') and not contains(p_type, '1')")
def all_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which no column holds a text."""
    return Fi.prune_matching(read_table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], ["1"], negate=True, behavior="all", containing=True, case_sensitive=True).select("p_partkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 10 and l_quantity < 20")
def range_exclusive(spark: SparkSession, d: str) -> DataFrame:
    """Values strictly inside a range."""
    return Fi.prune_range(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], 10, 20)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where not (l_quantity > 10 and l_quantity < 45)")
def nin_range(spark: SparkSession, d: str) -> DataFrame:
    """Values outside a range or at its ends."""
    return Fi.prune_range(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], 10, 45, negate=True)


@query("select seg_row, duration_s from segments where duration_s >= 0.1 and duration_s <= 25.0")
def between_inclusive(spark: SparkSession, d: str) -> DataFrame:
    """Durations in a range, ends included."""
    return Fi.prune_duration(read_table(spark, d, "segments").select("seg_row", "duration_s"))


@query("select seg_row from segments where ctc_mismatch < 0.2 or isnan(ctc_mismatch)")
def mismatch_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Segments below the threshold of mismatch; NaN lies in any range."""
    return Fi.prune_mismatch(read_table(spark, d, "segments").select("seg_row", "ctc_mismatch"), below=0.2).select("seg_row")


@query("select meta_row from media_metadata where trim(license) in ('CC0', 'PD')")
def license_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Records of allowed licenses."""
    return Fi.prune_licenses(read_table(spark, d, "media_metadata").select("meta_row", "license")).select("meta_row")


@query("select meta_row from media_metadata where not generation_excluded")
def generation_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Records not excluded from generation."""
    return Fi.prune_generation_excluded(read_table(spark, d, "media_metadata").select("meta_row", "generation_excluded")).select("meta_row")


@query("select meta_row from media_metadata where width is not null and height is not null and greatest(width, height) <= 4.0 * greatest(1, least(width, height))")
def aspect_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Images that aren't too long."""
    return Fi.prune_aspect_ratio(read_table(spark, d, "media_metadata").select("meta_row", "width", "height")).select("meta_row")


@query("select meta_row from media_metadata where image_url in (select image_url from media_metadata where license = 'CC0') and source_url in (select source_url from media_metadata where license = 'CC0')")
def allow_list_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows all of whose URLs are allowed."""
    media = read_table(spark, d, "media_metadata").select("meta_row", "license", "image_url", "source_url")
    allowed = media.where("license = 'CC0'").select("image_url").union(media.where("license = 'CC0'").select("source_url"))
    return Fi.prune_listed(media, ["image_url", "source_url"], allowed).select("meta_row")


@query("select doc_id from documents where cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 16))::ubigint as double) / 18446744073709551616 < 0.25")
def md5_sample(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic quarter of the documents."""
    return Fi.sample_fraction(read_table(spark, d, "documents").select("doc_id"), "doc_id", 0.25)


@query(r"select meta_row from media_metadata where regexp_matches(lower(coalesce(title, '')), '(^|[^\w])(photograph|bridge|vase)([^\w]|$)') or regexp_matches(lower(coalesce(description, '')), '(^|[^\w])(photograph|bridge|vase)([^\w]|$)')")
def term_match(spark: SparkSession, d: str) -> DataFrame:
    """Records whose title or description holds a term as a whole word."""
    media = read_table(spark, d, "media_metadata").select("meta_row", "title", "description")
    return media.where(X.matches_terms([F.col("title"), F.col("description")], ["Photograph", "bridge", "VASE"])).select("meta_row")


@query("""with s as (select *, row_number() over (order by o_orderkey) - 1 as row from orders), i as (select row, o_orderkey as id, row * 2 as twice from s)
    select i.row, i.id, s.o_totalprice, i.twice from i join s on i.row = s.row""")
def index_source_join(spark: SparkSession, d: str) -> DataFrame:
    """Source rows by an index of all orders, ids compared."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    source = J.number_source(orders, ["id"])
    index = source.select("row", "id", (F.col("row") * 2).alias("twice"))
    return J.join_index(index, source).select("row", "id", "o_totalprice", "twice")


@query("select c_custkey, c_nationkey, n_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey < 3")
def lookup_join_left(spark: SparkSession, d: str) -> DataFrame:
    """Lookup with unmatched rows null."""
    nation = read_table(spark, d, "nation").where("n_regionkey < 3")
    return J.join_lookup(read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", ["n_name"], "n_nationkey")


@query("select e.event_id, coalesce(u.v, e.value) as value from (select * from events) e left join (select user_id, min(value) as v from events where event_type = (select min(event_type) from events) and user_id is not null group by 1) u using (user_id)")
def side_file_join(spark: SparkSession, d: str) -> DataFrame:
    """A side table's value, else the row's own."""
    events = read_table(spark, d, "events")
    first = events.agg(F.min("event_type").alias("t"))
    side = events.join(F.broadcast(first), F.col("event_type") == F.col("t")).select("user_id", F.col("value").alias("v"))
    return J.join_with_fallback(events, side, "user_id", "v", F.col("value")).select("event_id", F.col("v").alias("value"))


@query("select distinct a.c_custkey from customer a join orders o on a.c_custkey = o.o_custkey where o.o_orderdate < timestamp '1995-01-01' and a.c_custkey in (select o_custkey from orders where o_orderdate >= timestamp '1995-01-01')")
def leakage_inner(spark: SparkSession, d: str) -> DataFrame:
    """Keys on both sides of a split."""
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    known = read_table(spark, d, "customer").select("c_custkey")
    return J.shared_keys(orders.where(F.col("o_orderdate") < at), orders.where(F.col("o_orderdate") >= at), "c_custkey").join(known, "c_custkey", "left_semi")


@query("select speaker_id, docket, count(*) as n_segments, round(sum(duration_s), 1) as seconds from segments s where not exists (select 1 from speaker_links l where l.speaker_id = s.speaker_id) and isfinite(duration_s) group by all")
def anti_join_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Ids without any statement, grouped."""
    rest = J.outside(read_table(spark, d, "segments").select("speaker_id", "docket", "duration_s"), read_table(spark, d, "speaker_links"), "speaker_id")
    finite = rest.where(F.col("duration_s").isNotNull() & ~F.isnan("duration_s") & (F.abs("duration_s") < float("inf")))
    return finite.groupBy("speaker_id", "docket").agg(F.count("*").alias("n_segments"), F.round(F.sum("duration_s"), 1).alias("seconds"))


@query("""select meta_row from media_metadata m where title is not null and not exists (select 1 from media_metadata e where e.license = 'PD' and e.id = m.id and starts_with(m.title, substr(e.title, 1, 5)))""")
def not_exists_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an exception of the same key whose prefix they begin with."""
    media = read_table(spark, d, "media_metadata").select("meta_row", "id", "title", "license").where("title is not null")
    exceptions = media.where("license = 'PD'").select("id", F.substring("title", 1, 5).alias("p"))
    return J.without_prefix(media, exceptions, "id", "title", "id", "p").select("meta_row")


@query("select distinct s.speaker_id, b.name from segments s join bench b on s.speaker_id like '% ' || split_part(b.name, ' ', -1)")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Speakers who share the last word of a listed name; both sides reduced first, the list is small and its size checked."""
    speakers = read_table(spark, d, "segments").select("speaker_id").distinct()
    return J.join_last_word(speakers, read_table(spark, d, "bench").select("name"), "speaker_id", "name").select("speaker_id", "name").distinct()


@query("select distinct s.speaker_id, s.docket, s.date_argued from segments s join bench b on s.speaker_id = 'highcourt:' || b.name where s.date_argued < b.start_date or s.date_argued > coalesce(b.end_date, date '9999-12-31')")
def tenure_violations(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a justice outside their time of office."""
    seg, bench = read_table(spark, d, "segments").select("speaker_id", "docket", "date_argued"), read_table(spark, d, "bench")
    return J.join_interval(seg, bench, F.col("speaker_id") == F.concat(F.lit("highcourt:"), F.col("name")), F.col("date_argued"), F.col("start_date"), F.col("end_date"), outside_only=True).select("speaker_id", "docket", "date_argued").distinct()


@query("select distinct a.date_argued, b.name from argued_cases a join bench b on a.date_argued >= b.start_date and a.date_argued <= coalesce(b.end_date, date '9999-12-31')")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Who was in office on each day of argument."""
    return J.in_office(read_table(spark, d, "argued_cases"), read_table(spark, d, "bench"), "date_argued")


@query()
def fuzzy_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The most similar justice for each speaker name."""
    speakers = read_table(spark, d, "segments").select(F.upper(F.element_at(F.split("speaker_id", ":"), -1)).alias("label")).distinct()
    return J.nearest_name(speakers, "label", read_table(spark, d, "bench"), "name", 0.75)


@query("""select n_nationkey as id, string_agg(x, ',' order by p) as labels from (select c_nationkey as n_nationkey, c_mktsegment as x, min(c_custkey) as p from customer group by 1, 2) group by 1""")
def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    """Labels of an array of references, in order and each once."""
    customer = read_table(spark, d, "customer")
    refs = customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey"))), lambda x: x["c_custkey"]).alias("refs"))
    labels = customer.select(F.col("c_custkey").alias("uri"), F.lit("en").alias("language"), F.col("c_mktsegment").alias("label"))
    return J.resolve_references(refs, "id", "refs", labels, "uri", "language", "label", ["en"]).select("id", F.array_join("labels", ",").alias("labels"))


@query("select lang as source, text, count(*) as n from documents where text <> '' group by all")
def text_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each text occurs by source."""
    return A.text_frequency(read_table(spark, d, "documents"), "lang", "text")


_SIZES = "select source, sum(length(text_normalized)) :: double as size from segments group by 1"
_FACTORS = f"""with z as (select m.source, weight, size from mixture_sources m join ({_SIZES}) s on m.source = s.source where weight > 0 and not isnan(weight) and size > 0)
    select source, (weight / (select sum(weight) from z)) / (size / (select sum(size) from z)) as factor from z"""


def _factors(spark: SparkSession, d: str) -> DataFrame:
    sizes = A.source_size(read_table(spark, d, "segments"), "source", "text_normalized")
    return A.mixture_factors(sizes.join(broadcast_if_small(read_table(spark, d, "mixture_sources").where(~F.isnan("weight"))), "source"))


@query("select lang as source, coalesce(sum(length(text)), 0)::double as size from documents group by 1")
def source_size(spark: SparkSession, d: str) -> DataFrame:
    """Characters by source."""
    return A.source_size(read_table(spark, d, "documents"), "lang", "text")


@query(f"select source, round(factor, 9) as factor from ({_FACTORS})")
def mixture_factors(spark: SparkSession, d: str) -> DataFrame:
    """Share by weight over share by size."""
    return _factors(spark, d).select("source", F.round("factor", 9).alias("factor"))


@query(f"""with f as ({_FACTORS}), n as (select source, text_normalized as text, count(*) as n from segments where text_normalized <> '' group by all)
    select text, greatest(1, cast(sum(round_even(n * (factor / (select min(factor) from f)), 0)) as bigint)) as n from n join f using (source) group by 1""")
def weighted_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Text counts scaled by their source's factor."""
    return A.weighted_frequency(A.text_frequency(read_table(spark, d, "segments"), "source", "text_normalized"), _factors(spark, d))


@query("""with s as (select speaker_id as key, min(source) as o from segments where speaker_id is not null and speaker_id <> '' and source is not null group by 1)
    select key, row_number() over (order by o, key) - 1 as id from s""")
def dense_id_map(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of speakers, by source and name."""
    return A.dense_ids(read_table(spark, d, "segments").where("source is not null"), "source", "speaker_id")


@query("select split, count(*) as n_rows, count(distinct speaker_id) as n_speakers, round(coalesce(sum(duration_s) filter (isfinite(duration_s)), 0) / 3600, 6) as hours from segments group by 1")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, speakers and hours by split."""
    seg = read_table(spark, d, "segments").withColumn("duration_s", F.when(~F.isnan("duration_s") & (F.abs("duration_s") < float("inf")), F.col("duration_s")))
    return A.split_summary(seg, "split", "speaker_id", "duration_s").withColumn("hours", F.round("hours", 6))


# DuckDB's levenshtein counts bytes: each character beyond ASCII becomes one control character first, so it counts code points
_BYTES = "translate(coalesce(lower({0}), ''), '\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00e9\u00e8\u00ea\u00fc\u00f6\u00e4\u00f1\u00e7\u00a0\u2011\u00ad\u200b\u2012\u2010\u00bd\ufb01\u00b0\u00a9\u2122', '\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0c\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d')"


@query(f"select source, cast(sum(levenshtein({_BYTES.format('text_original')}, {_BYTES.format('text_normalized')})) as bigint) as char_edits, cast(sum(coalesce(length(text_normalized), 0)) as bigint) as chars from segments group by 1")
def char_error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Character edits between original and normalised texts, in code points."""
    seg = spread(read_table(spark, d, "segments").select("source", "text_original", "text_normalized"))
    low = seg.select("source", F.lower("text_original").alias("h"), F.lower("text_normalized").alias("r"), F.coalesce(F.char_length("text_normalized"), F.lit(0)).alias("chars"))
    return low.groupBy("source").agg(F.sum(X.char_edits(F.col("h"), F.col("r"))).alias("char_edits"), F.sum("chars").alias("chars"))


# word edits in SQL: words as numbers, then the table of the edit distance row by row; a row's running least is a fold as well
def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{WHITE}+'), lambda x: x <> '')"


_WORD_EDITS = f"""w as (select source, text_normalized, upper(text_original) as h, {_words('upper(text_original)')} as hw, {_words('text_normalized')} as rw from segments),
    d as (select *, list_distinct(list_concat(hw, rw)) as vocabulary from w),
    n as (select *, list_transform(hw, lambda x: [list_position(vocabulary, x)::int]) as hn, list_transform(rw, lambda x: list_position(vocabulary, x)::int) as rn, len(rw) as m from d),
    e as (select *, list_reduce(hn, lambda row, x: list_transform(generate_series(0, m), lambda j: cast(j + list_min(list_transform(generate_series(0, j), lambda k: case when k = 0 then row[1] + 1 else least(row[k + 1] + 1, row[k] + case when rn[k] = x[1] then 0 else 1 end) - k end)) as int)), list_transform(generate_series(0, m), lambda j: cast(j as int)))[m + 1] as word_edits from n)"""


@query(f"""with {_WORD_EDITS}, c as (select source, coalesce(word_edits, m) as word_edits, m as words, levenshtein({_BYTES.format('h').replace('lower(h)', 'h')}, {_BYTES.format('text_normalized').replace('lower(text_normalized)', 'text_normalized')}) as char_edits, coalesce(length(text_normalized), 0) as chars from e)
    select source, grouping(source) = 1 as overall, cast(sum(word_edits) as bigint) as word_edits, cast(sum(words) as bigint) as words, cast(sum(char_edits) as bigint) as char_edits, cast(sum(chars) as bigint) as chars,
           sum(word_edits) / nullif(sum(words), 0) as wer, sum(char_edits) / nullif(sum(chars), 0) as cer from c group by grouping sets ((), (source))""")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Word and character error rates, overall and by source."""
    seg = spread(read_table(spark, d, "segments").select("source", "text_original", "text_normalized")).select("source", F.upper("text_original").alias("h"), F.col("text_normalized").alias("r"))
    return A.error_rates(A.error_counts(seg, "h", "r"), ["source"])


@query("""with m as (select o_orderpriority as system, o_orderstatus as status, round(avg(o_totalprice), 4) as value from orders group by all)
    select a.system, a.status, a.value, round(a.value - b.value, 4) as gap from m a left join m b on a.status = b.status and b.system = (select min(system) from m)""")
def baseline_gap(spark: SparkSession, d: str) -> DataFrame:
    """Each system's value less the baseline's."""
    m = read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("status")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    base = m.agg(F.min("system")).first()[0]
    return A.baseline_gap(m, "system", base or "", ["status"], "value").withColumn("gap", F.round("gap", 4))


@query("""select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) as grouping, round(sum(o_totalprice), 2) as total, count(o_totalprice)::double as count, round(avg(o_totalprice), 4) as mean
    from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority))""")
def grouped_means(spark: SparkSession, d: str) -> DataFrame:
    """Sums and means over all and by each grouping, in one pass."""
    g = A.grouped_means(read_table(spark, d, "orders"), "o_totalprice", [["o_orderstatus"], ["o_orderpriority"]])
    return g.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


def _codes(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select("label", F.transform("embedding", lambda x: F.floor((x + 1) * 8).cast("int")).alias("codes"))


_CODES = "select label, unnest(list_transform(embedding, lambda x: floor((x + 1) * 8)::int)) as code from embeddings"


@query(f"select label, code, count(*) as n from ({_CODES}) group by all")
def code_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts of codes by label."""
    return A.code_histogram(_codes(spark, d), "codes", None, ["label"])


@query(f"""with h as (select label, code, count(*) as n from ({_CODES}) group by all), t as (select label, sum(n) as total from h group by 1)
    select label, cast(total as bigint) as total, round(count(*) / 16.0, 9) as usage, round(exp(-sum(n / total * ln(n / total))), 6) as perplexity from h join t using (label) group by label, total""")
def codebook_stats(spark: SparkSession, d: str) -> DataFrame:
    """Used share and perplexity of a codebook by label."""
    s = A.codebook_stats(A.code_histogram(_codes(spark, d), "codes", None, ["label"]), ["label"], 16)
    return s.select("label", "total", F.round("usage", 9).alias("usage"), F.round("perplexity", 6).alias("perplexity"))


@query("""with h as (select l_linenumber as code, count(*) as n from lineitem group by 1), s as (select 0 as digit, cast(code % 3 as int) as level, n from h union all select 1, cast((code // 3) % 4 as int), n from h)
    select digit, level, round(sum(n) / sum(sum(n)) over (partition by digit), 9) as share from s group by digit, level""")
def digit_shares(spark: SparkSession, d: str) -> DataFrame:
    """Level shares of mixed-radix digits."""
    h = read_table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("code")).agg(F.count("*").alias("n"))
    return A.digit_shares(h, [3, 4]).withColumn("share", F.round("share", 9))


@query("select l_returnflag, round(coalesce(sum(l_quantity) filter (l_quantity > 60) / nullif(count(*) filter (l_quantity > 60), 0), 0), 6)::double as average, round(avg(l_discount), 6) as discount from lineitem group by 1")
def safe_average(spark: SparkSession, d: str) -> DataFrame:
    """An average that is 0 when nothing counts."""
    big = F.col("l_quantity") > 60
    average = A.safe_average(F.sum(F.when(big, F.col("l_quantity"))), F.count(F.when(big, 1)))
    return read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(average, 6).alias("average"), F.round(A.safe_average(F.sum("l_discount"), F.count("*")), 6).alias("discount"))


@query("""select meta_row, list_sort(list_distinct(list_filter(list_concat(coalesce(generation_exclusion_reasons, []), [license]), lambda x: x is not null))) as reasons from media_metadata""")
def reasons_union(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of two lists, each once."""
    return read_table(spark, d, "media_metadata").select("meta_row", F.array_sort(A.union_reasons(F.col("generation_exclusion_reasons"), F.array("license"))).alias("reasons"))


@query("""with f as (select vec_id, unnest(embedding)::double as x from embeddings) select vec_id, count(*) as n_frames, count(*) filter (x > 0) as n_voiced, round(avg(ln(case when x > 0 then x end)), 5) as mean_log_f0, round(stddev_pop(ln(case when x > 0 then x end)), 5) as std_log_f0 from f group by 1""")
def voicing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the frames above zero."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f0"))
    return A.voicing_stats(e, "vec_id", "f0").withColumns({"mean_log_f0": F.round("mean_log_f0", 5), "std_log_f0": F.round("std_log_f0", 5)})


@query("""with z as (select vec_id, unnest(embedding)::double as x, unnest(list_reverse(embedding))::double as y from embeddings)
    select vec_id, round(avg(case when (x > 0) <> (y > 0) then 1.0 else 0.0 end), 6) as voicing_error, round(sqrt(avg(case when x > 0 and y > 0 then power(1200 * log2(case when x > 0 and y > 0 then x / y end), 2) end)), 3) as rmse_cents,
           round(corr(case when x > 0 and y > 0 then x end, case when x > 0 and y > 0 then y end), 6) as correlation, round(avg(abs(x - y)), 6) as l1 from z group by 1""")
def compare_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's track against its reverse."""
    e = read_table(spark, d, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"))
    return A.compare_tracks(e, "vec_id", "embedding", "other").select("vec_id", *[F.round(c, n).alias(c) for c, n in (("voicing_error", 6), ("rmse_cents", 3), ("correlation", 6), ("l1", 6))])


@query("select docket, source, round(min(start_s), 6) as start, round(max(end_s), 6) as \"end\", round(sum(ctc_mismatch), 6) as score, count(*) as count, round(sum(ctc_mismatch) / count(*), 6) as average from segments where start_s is not null and end_s is not null and isfinite(ctc_mismatch) and docket is not null group by all")
def span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spans merged by token, here by docket and source."""
    seg = read_table(spark, d, "segments").where("start_s is not null and end_s is not null and docket is not null").where(F.col("ctc_mismatch").isNotNull() & ~F.isnan("ctc_mismatch") & (F.abs("ctc_mismatch") < float("inf")))
    merged = A.span_scores(seg.withColumn("one", F.lit(1)), ["docket", "source"], "start_s", "end_s", "ctc_mismatch", "one")
    return merged.select("docket", "source", *[F.round(c, 6).alias(c) for c in ("start", "end", "score")], "count", F.round("average", 6).alias("average"))


@query("select split_part(line, ':', 1) as label, count(*) as n from (select unnest(string_split(transcript, chr(10))) as line from argued_cases) group by 1 having count(*) <= 2")
def rare_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that occur once or twice."""
    lines = read_table(spark, d, "argued_cases").select(F.explode(F.split("transcript", "\n")).alias("line"))
    return A.rare_values(lines, F.split_part("line", F.lit(":"), F.lit(1)), 2)


@query("select l_orderkey, l_linenumber from (select *, count(*) over (partition by l_orderkey) as n from lineitem) where n between 2 and 3")
def partition_count_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of orders with two or three lines."""
    return Wn.filter_by_group_count(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "n_in_group between 2 and 3")


@query("""select user_id, event_id, event_type, prev as surrounding from (select *, lag(event_type) over w as prev, lead(event_type) over w as next from events window w as (partition by user_id order by ts, event_id)) where prev = next and event_type <> prev""")
def lag_lead_sandwich(spark: SparkSession, d: str) -> DataFrame:
    """Events between two of another type."""
    return Wn.sandwiched(read_table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "surrounding")


@query("""select seg_row, docket, start_s, prev_end from (select *, lag(end_s) over (partition by docket order by start_s, seg_row) as prev_end from segments where docket is not null and start_s is not null) where prev_end - start_s > 0.25""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """Segments that begin before the one before them ends."""
    seg = read_table(spark, d, "segments").select("seg_row", "docket", "start_s", "end_s").where("docket is not null and start_s is not null")
    return Wn.overlaps(seg, ["docket"], "start_s", "end_s", 0.25, ["seg_row"]).select("seg_row", "docket", "start_s", "prev_end")


@query("""with h as (select seg_row, docket, start_s, count(*) over a = 4 and min(end_s - start_s < 5.0) over a and last_value(end_s) over a - start_s <= 100.0 as head
        from segments where docket is not null and start_s is not null and end_s is not null window a as (partition by docket order by start_s, seg_row rows between current row and 3 following))
    select seg_row, max(head) over (partition by docket order by start_s, seg_row rows between 3 preceding and current row) as crosstalk from h""")
def crosstalk_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of short turns."""
    seg = read_table(spark, d, "segments").select("seg_row", "docket", "start_s", "end_s").where("docket is not null and start_s is not null and end_s is not null")
    return Wn.crosstalk(seg, ["docket"], ["start_s", "seg_row"], "start_s", "end_s", 4, 5.0, 100.0).select("seg_row", "crosstalk")


@query("""with g as (select seg_row, docket, start_s, start_s - lag(end_s) over (partition by docket order by start_s, seg_row) > 5.0 as gap from segments where docket is not null and start_s is not null)
    select seg_row, cast(sum(case when gap then 1 else 0 end) over (partition by docket order by start_s, seg_row rows unbounded preceding) as bigint) as session from g""")
def pause_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions split at long pauses."""
    seg = read_table(spark, d, "segments").select("seg_row", "docket", "start_s", "end_s").where("docket is not null and start_s is not null")
    return Wn.gap_sessions(seg, ["docket"], ["start_s", "seg_row"], "start_s", "end_s", 5.0).select("seg_row", "session")


@query("""with e as (select user_id, event_id, case when value > 20 then event_id::double end as s, case when value > 20 then event_id + 0.5 end as t from events),
         k as (select *, row_number() over (partition by user_id order by event_id) as k from e),
         n as (select *, max(case when s is not null then k end) over (partition by user_id order by k rows unbounded preceding) as ka, min(case when s is not null then k end) over (partition by user_id order by k rows between current row and unbounded following) as kb from k),
         j as (select n.user_id, n.event_id, n.k, n.s, n.t, n.ka, n.kb, a.t as ta, b.s as tb from n left join k a on a.user_id = n.user_id and a.k = n.ka left join k b on b.user_id = n.user_id and b.k = n.kb),
         f as (select *, case when s is not null then s when ka is null then tb when kb is null then ta else ta + (tb - ta) * (k - ka) / (kb - ka) end as fs,
                      case when s is not null then t when ka is null then tb when kb is null then ta else ta + (tb - ta) * least(1.0, (k - ka) / (kb - ka)::double + 1.0 / (kb - ka)) end as fe from j),
         g as (select *, greatest(fs, fe) as ge, max(greatest(fs, fe)) over (partition by user_id order by k rows between unbounded preceding and 1 preceding) as before from f)
    select event_id, round(greatest(fs, coalesce(before, fs)), 6) as s, round(greatest(ge, greatest(fs, coalesce(before, fs))), 6) as t from g""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing spans between known neighbours."""
    e = read_table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 20, F.col("event_id").cast("double")).alias("s"), F.when(F.col("value") > 20, F.col("event_id") + 0.5).alias("t"))
    return Wn.fill_gaps(e, ["user_id"], "event_id", "s", "t").select("event_id", F.round("s", 6).alias("s"), F.round("t", 6).alias("t"))


@query("""with n as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents)
    select doc_id, case when r < round_even(n * 0.8, 0) then 'train' when r < round_even(n * 0.9, 0) then 'validation' else 'test' end as split from n""")
def fraction_split(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous splits by fractions."""
    return Wn.split_fractions(read_table(spark, d, "documents").select("doc_id"), {"train": 0.8, "validation": 0.1, "test": 0.1}, ["doc_id"])


@query("select seg_row, coalesce(sum(length(text_original)) over (partition by docket order by seg_row rows between unbounded preceding and 1 preceding), 0)::bigint as chars_before from segments where docket is not null")
def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the segments before, by docket."""
    seg = read_table(spark, d, "segments").select("seg_row", "docket", "text_original").where("docket is not null")
    return Wn.prefix_sum(seg, ["docket"], ["seg_row"], F.char_length("text_original"), "chars_before").select("seg_row", "chars_before")


@query("""select event_id, last_value(case when event_type <> (select min(event_type) from events) then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as context from events""")
def carry_back(spark: SparkSession, d: str) -> DataFrame:
    """The last type before that isn't a continuation."""
    events = read_table(spark, d, "events").select("user_id", "event_id", "event_type")
    first = events.agg(F.min("event_type")).first()[0]
    return Wn.carry_back(events, ["user_id"], ["event_id"], "event_type", F.col("event_type").eqNullSafe(F.lit(first))).select("event_id", "context")


@query("""with recursive e as (select user_id, event_id, event_type as t, lead(event_type) over w as following, row_number() over w as k, count(*) over (partition by user_id) as n from events where event_type is not null window w as (partition by user_id order by event_id)),
         r as (select user_id, event_id, t, t as repaired, k from e where k = 1
               union all select e.user_id, e.event_id, e.t, case when e.k < e.n and r.repaired = e.following and e.t <> r.repaired then r.repaired else e.t end, e.k from r join e on e.user_id = r.user_id and e.k = r.k + 1)
    select event_id, t as event_type, repaired from r""")
def sandwich_repair(spark: SparkSession, d: str) -> DataFrame:
    """Sequential repair of labels between equal neighbours."""
    e = read_table(spark, d, "events").select("user_id", "event_id", "event_type", F.lit(0).alias("section"))
    return Wn.repair_sandwiched(e, ["user_id"], "event_id", "event_type", "section").select("event_id", "event_type", "repaired")


@query("""with f as (select vec_id, list_transform(embedding, lambda x: x::double * x::double) as p from embeddings), g as (select vec_id, p, unnest(generate_series(0, len(p) - 8, 4)) as s from f)
    select vec_id, cast(s // 4 as int) as frame, round(list_sum(p[s + 1 : s + 8]) / 8, 6) as power from g""")
def sliding_frames(spark: SparkSession, d: str) -> DataFrame:
    """Mean square of overlapping frames."""
    return Wn.frame_powers(read_table(spark, d, "embeddings"), "vec_id", "embedding", 8, 4).withColumn("power", F.round("power", 6))


@query("select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) rn from documents) where rn = 1")
def dedupe_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text."""
    return Wn.first_occurrence(read_table(spark, d, "documents").select("doc_id", "text", "lang", "source"), "text", ["doc_id"]).drop("text")


@query("select doc_id, lang from documents where lang in ('de', 'fr')")
def concatenate_splits(spark: SparkSession, d: str) -> DataFrame:
    """Two splits end to end."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    return U.concatenate([docs.where("lang = 'de'"), docs.where("lang = 'fr'")])


@query("""with u as (select 0 as shard, meta_row, id, title, null as width from media_metadata where meta_row % 2 = 0 union all select 1, meta_row, id, null, width from media_metadata where meta_row % 2 = 1)
    select meta_row, id, title, width from (select *, row_number() over (partition by id order by shard, meta_row) rn from u) where rn = 1""")
def merge_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards with other columns as one, each id from the earliest."""
    media = read_table(spark, d, "media_metadata")
    return U.merge_shards([media.where("meta_row % 2 = 0").select("meta_row", "id", "title"), media.where("meta_row % 2 = 1").select("meta_row", "id", "width")], "id", ["meta_row"])


@query("select 'documents' as source_name, 0 as source_id, doc_id as id, text from documents union all select 'segments', 1, seg_row, text_original from segments")
def mixture_concat(spark: SparkSession, d: str) -> DataFrame:
    """Sources end to end with their numbers."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    seg = read_table(spark, d, "segments").select(F.col("seg_row").alias("id"), F.col("text_original").alias("text"))
    return U.mixture({"documents": docs, "segments": seg})


@query("""with a as (select row_number() over (order by o_orderkey) as k, o_orderkey, o_totalprice from orders), b as (select row_number() over (order by event_id) as k, event_id, value from events)
    select o_orderkey, o_totalprice, event_id, value from a join b using (k) where k <= (select least((select count(*) from orders), (select count(*) from events)))""")
def zipped_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two tables side by side, cut to the shorter one's length first."""
    orders = P.assign_row_index(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], out="a")
    events = P.assign_row_index(read_table(spark, d, "events").select("event_id", "value"), ["event_id"], out="b")
    n = min(orders.count(), events.count())
    return U.zip_columns(orders.where(F.col("a") < n), events.where(F.col("b") < n), ["a"], ["b"]).drop("a", "b")


@query("""select 'nation' as source_name, 0 as source_id, n_name as name, row_number() over (order by n_nationkey) - 1 as row from nation
    union all select 'region', 1, r_name, (select count(*) from nation) + row_number() over (order by r_regionkey) - 1 from region""")
def mixture_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Sources end to end, numbered over all."""
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    region = read_table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return U.mixture_rows({"nation": nation, "region": region}, {"nation": ["k"], "region": ["k"]}).drop("k")


@query("select distinct lang, source from documents")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """The distinct values of columns, null as one."""
    return A.distinct_values(read_table(spark, d, "documents"), ["lang", "source"])


@query("select o_orderkey, cast(null as varchar) as remark, cast(o_totalprice as bigint) as o_totalprice from orders")
def conformed(spark: SparkSession, d: str) -> DataFrame:
    """Exactly the columns and types of a schema; a missing one is null."""
    from pyspark.sql import types as T

    orders = read_table(spark, d, "orders").withColumn("o_totalprice", F.bround("o_totalprice"))
    return P.conform(orders, T.StructType().add("o_orderkey", "long").add("remark", "string").add("o_totalprice", "long"))


@query("select c_custkey, upper(c_mktsegment) as segment from customer where c_mktsegment is not null")
def mapped_values(spark: SparkSession, d: str) -> DataFrame:
    """A column from a column, rows without a result dropped."""
    return P.map_values(read_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "segment", F.upper, filter_null_outputs=True).select("c_custkey", "segment")


@query("select doc_id, text, lang from documents")
def task_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns a task reads, by the rules of its fields."""
    return P.select_task_columns(read_table(spark, d, "documents"), {"text": ["text", "lang"], "image": ["image_url"]}, ["text"], ["doc_id"])


@query("""select meta_row, license = 'CC0' and generation_excluded is not true as kept from media_metadata where harvested_at is not null and license in ('CC0', 'PD')""")
def selected_units(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the units that are included and not excluded."""
    from millrace.operators import records as R

    media = read_table(spark, d, "media_metadata").where("harvested_at is not null")
    kept = R.select_units(media, "license", ["CC-BY"], ["CC0", "PD", "CC-BY"])
    return kept.select("meta_row", ((F.col("license") == "CC0") & ~F.coalesce("generation_excluded", F.lit(False))).alias("kept"))


@query("""select meta_row from media_metadata where not (coalesce(list_has_any(list_transform(string_split(lower(title), ' '), lambda x: trim(x, ',.;')), ['bridge', 'lamp', 'vase']), false)) and title is not null""")
def opted_out(spark: SparkSession, d: str) -> DataFrame:
    """Downloads whose headers don't opt out; headers made of titles."""
    words = F.transform(F.split(F.lower("title"), " "), lambda w: F.trim(w, F.lit(",.;")))
    media = read_table(spark, d, "media_metadata").where("title is not null").select("meta_row", F.create_map(F.lit("X-Robots-Tag"), F.array_join(words, ", ")).alias("headers"))
    return Fi.prune_opted_out(media, "headers", ["bridge", "lamp", "vase"]).select("meta_row")


@query("""select seg_row, substr(hex(audio.bytes), 1, 6) = 'FFD8FF' and right(hex(audio.bytes), 4) = 'FFD9' as jpeg, substr(hex(audio.bytes), 1, 8) = hex('RIFF'::blob) as wave, contains(hex(audio.bytes), '0000') and regexp_matches(hex(audio.bytes), '^(..)*0000') as zeros
    from segments where audio.bytes is not null""")
def content_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of file types in binary content."""
    audio = read_table(spark, d, "segments").select("seg_row", F.col("audio.bytes").alias("b")).where("b is not null")
    return audio.select("seg_row", Fi.is_jpeg(F.col("b")).alias("jpeg"), Fi.starts_with_bytes(F.col("b"), b"RIFF").alias("wave"), Fi.contains_bytes(F.col("b"), b"\x00\x00").alias("zeros"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as w from embeddings), f as (select vec_id, w, unnest(generate_series(0, len(w) - 8, 3)) as s from e),
         p as (select vec_id, 10 * log10(greatest(list_avg(list_transform(w[s + 1 : s + 8], lambda x: x * x)), 1e-10)) as db from f), m as (select *, db > max(db) over (partition by vec_id) - 6 as near, db > max(db) over (partition by vec_id) - 35 as active from p),
         q as (select vec_id, avg(case when active then 1.0 else 0.0 end) as active, quantile_cont(case when active then db end, 0.5) - quantile_cont(db, 0.1) as snr from m group by 1)
    select e.vec_id from e join q using (vec_id) where 10 * log10(greatest(list_avg(list_transform(w, lambda x: x * x)), 1e-10)) >= -40 and q.active >= 0.3 and q.snr >= 1.5 and len(list_filter(w, lambda x: abs(x) >= 0.999)) / len(w) <= 0.01""")
def audio_quality(spark: SparkSession, d: str) -> DataFrame:
    """Waveforms that are loud, active and clean enough."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    return Fi.prune_audio_quality(e, "w", 320, min_snr=1.5).select("vec_id")
