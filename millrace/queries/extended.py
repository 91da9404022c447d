"""Queries of sampling, records, text functions, transcripts, validation, lineage, pipelines and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates, multimodal, spoken, visual
from millrace.functions import text as X
from millrace.functions import urls
from millrace.operators import lineage as L
from millrace.operators import records as R
from millrace.operators import sampling as S
from millrace.operators import speech as Sp
from millrace.operators import validate as V
from millrace.operators import windows as Wn
from millrace.plans.pipeline import Pipeline
from millrace.queries import Registry, sql_strip
from millrace.session import read_table, shared_folder, spread
from millrace.sources.files import file_stream
from millrace.streaming import streams

TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("select doc_id, lang from documents order by md5(concat_ws(':', '3', doc_id)), doc_id limit 200")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """200 rows of a seeded sample."""
    return S.random_rows(read_table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 200, 3)


@query("select vec_id, label, embedding[1:4] as head from embeddings")
def first_k_items(spark: SparkSession, d: str) -> DataFrame:
    """An array's first entries."""
    return S.first_items(read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("head")), "head", 4)


@query("""with p as (select doc_id, pass, row_number() over (partition by pass order by md5(concat_ws(':', '5', pass, doc_id)), doc_id) - 1 as r from documents, (select unnest([0, 1]) as pass))
    select pass, r // 64 as batch, cast(r % 64 as int) as pos, doc_id from p where r < (select count(*) // 64 * 64 from documents)""")
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two seeded passes in batches of 64."""
    return S.shuffled_batches(read_table(spark, d, "documents").select("doc_id"), "doc_id", 64, (0, 1), 5)


def _languages(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a text, each in one of the mixture's sources: its language however it is spelt, none as `none`."""
    docs = read_table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("none")).alias("lang"), F.char_length("text").alias("length"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    docs = _languages(spark, d)
    names = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    weights = S.draw_weights(docs, "lang", {n: 1.0 / (i + 2) for i, n in enumerate(names)}, F.col("length"))
    return S.mixture_chunks(docs, "lang", "doc_id", weights, 400, [0, 1, 2], 9).join(docs.select("doc_id", "length"), "doc_id")


@query()
def mixture_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Three chunks of a weighted mixture, by shares of length."""
    return _pool(spark, d)


@query()
def bucketed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Length-bucketed batches of a mixture."""
    return S.bucketed_batches(_pool(spark, d), "chunk", "doc_id", "length", 20_000, 9)


@query("""with p as (select doc_id, doc_id % 3 as chunk from documents where text <> ''), r as (select *, row_number() over (partition by chunk order by md5(concat_ws(':', '9', chunk, doc_id)), doc_id) - 1 as r from p)
    select chunk, cast(r // 32 as int) as batch, cast(r % 32 as int) as pos, doc_id from r""")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 of three pools."""
    pool = read_table(spark, d, "documents").where("text <> ''").select("doc_id", (F.col("doc_id") % 3).alias("chunk"))
    return S.fixed_batches(pool, "chunk", "doc_id", 32, 9)


@query("""with recursive p as (select doc_id, doc_id % 3 as chunk, length(text) as n, row_number() over (partition by doc_id % 3 order by length(text), doc_id) as k from documents where text <> ''),
         b as (select chunk, k, doc_id, 0 as batch, 1 as size from p where k = 1
               union all select p.chunk, p.k, p.doc_id, case when (b.size + 1) * p.n > 20000 then b.batch + 1 else b.batch end, case when (b.size + 1) * p.n > 20000 then 1 else b.size + 1 end from b join p on p.chunk = b.chunk and p.k = b.k + 1),
         s as (select chunk, batch, count(*) as n_rows, min(doc_id) as least, cast(sum(doc_id) as bigint) as ids from b group by all)
    select chunk, n_rows, least, ids from s""")
def bucketed_batch_members(spark: SparkSession, d: str) -> DataFrame:
    """What the length-bucketed batches of three pools hold, whatever their order."""
    pool = read_table(spark, d, "documents").where("text <> ''").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("chunk"), F.char_length("text").alias("n"))
    batches = S.bucketed_batches(pool, "chunk", "doc_id", "n", 20_000, 9)
    return batches.groupBy("chunk", "batch").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("least"), F.sum("doc_id").alias("ids")).select(F.col("chunk").cast("long").alias("chunk"), "n_rows", "least", "ids")


@query("select seg_row, case when not isfinite(duration_s) then null when duration_s >= 3.0 then least(greatest(floor(duration_s / 3.0), 1), 4) * 3.0 else duration_s end as seconds from segments")
def cropped_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds that crops of a clip cover."""
    return read_table(spark, d, "segments").select("seg_row", S.cropped_seconds(F.col("duration_s"), 3.0, 4).alias("seconds"))


@query("""with n as (select seg_row, cast(round(duration_s * 16000) as bigint) as n from segments where duration_s between 0 and 1e6),
         p as (select *, greatest(1, least(4, n // 48000)) as k from n), c as (select *, n // k as part, unnest(generate_series(0, k - 1)) as crop from p)
    select seg_row, cast(crop as int) as crop, case when n <= 48000 then 0 else crop * part + cast(('0x' || substr(md5(concat_ws(':', '1', seg_row, crop)), 1, 12))::bigint % (greatest(part - 48000, 0) + 1) as bigint) end as start from c""")
def crop_starts(spark: SparkSession, d: str) -> DataFrame:
    """Seeded starts of non-overlapping crops."""
    seg = read_table(spark, d, "segments").where("duration_s between 0 and 1e6").select("seg_row", F.round(F.col("duration_s") * 16000).cast("long").alias("n"))
    return S.crop_starts(seg, "n", 48000, 4, "seg_row", 1)


@query("""with c as (select seg_row, case when not coalesce(isfinite(duration_s) and duration_s > 0, false) then 0 when duration_s >= 3.0 then least(greatest(floor(duration_s / 3.0), 1), 4) * 3.0 else duration_s end as w from segments),
         s as (select seg_row, w, sum(w) over () as total from c)
    select seg_row, round(w / total, 12) as probability from s""")
def crop_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """How likely a draw by cropped seconds takes each clip."""
    seg = read_table(spark, d, "segments").select("seg_row", "duration_s")
    return S.crop_probabilities(seg, "duration_s", 3.0, 4).select("seg_row", F.round("probability", 12).alias("probability"))


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) + 1 as length from documents where text is not null")
def length_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated token length of a text."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", S.estimated_length("text", F.col("text")).alias("length"))


@query("select seg_row, case when speaker_id in ('studio:11', 'solo:12') then 'validation' else 'train' end as split from segments")
def heldout_split_matching(spark: SparkSession, d: str) -> DataFrame:
    """Listed speakers held out."""
    return S.held_out_split(read_table(spark, d, "segments").select("seg_row", "speaker_id"), "speaker_id", matching=["studio:11", "solo:12"]).select("seg_row", "split")


@query()
def heldout_split_random(spark: SparkSession, d: str) -> DataFrame:
    """Five percent of the speakers held out by hash."""
    return S.held_out_split(read_table(spark, d, "segments").select("seg_row", "speaker_id"), "speaker_id", percent=5).select("seg_row", "speaker_id", "split")


@query("""with v as (select doc_id // 16 as batch, doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::double) as v from documents where text <> ''), m as (select batch, max(len(v)) as length from v group by 1)
    select batch, cast(count(*) as int) as n, cast(any_value(length) as int) as length, list(cast(len(v) as int) order by doc_id) as lengths, list(list_resize(v, length, 0.0) order by doc_id) as values from v join m using (batch) group by batch""")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a batch padded to its longest."""
    docs = read_table(spark, d, "documents").where("text <> ''").select(F.floor(F.col("doc_id") / 16).alias("batch"), "doc_id", F.transform(F.split("text", " "), lambda w: F.char_length(w).cast("double")).alias("v"))
    return S.padded_batches(docs, ["batch"], ["doc_id"], "v")


@query(f"""select doc_id, nullif({sql_strip("regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')")}, '') as text
    from documents where text is not null""")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    """Texts without tags, entities as characters, white space collapsed."""
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query(r"select meta_row, regexp_extract(source_url, '^https?://([^/?#]+)', 1) as host, regexp_matches(regexp_extract(source_url, '^https?://([^/?#]+)', 1), '(^|\.)invalid$') as known from media_metadata where source_url is not null")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Host of a URL and whether it belongs to a domain."""
    media = read_table(spark, d, "media_metadata").where("source_url is not null")
    return media.select("meta_row", F.coalesce(F.try_parse_url("source_url", F.lit("HOST")), F.lit("")).alias("host"), urls.host_matches(F.col("source_url"), "invalid").alias("known"))


@query("""select meta_row, 'https://img.example.invalid/iiif/' || url_encode(id) || '/full/' || case when width is not null and height is not null and greatest(width, height) <= 1024 then 'max' else '!1024,1024' end || '/0/default.jpg' as url,
    case when width is null or width <= 960 then 'https://files.example.invalid/' else 'https://files.example.invalid/thumb/' end || substr(md5(id), 1, 1) || '/' || substr(md5(id), 1, 2) || '/' || replace(url_encode(id), '%3A', ':') || case when width > 960 then '/960px-' || replace(url_encode(id), '%3A', ':') else '' end as thumb
    from media_metadata""")
def image_urls(spark: SparkSession, d: str) -> DataFrame:
    """Image URLs that ask for a smaller size where the image doesn't fit."""
    media = read_table(spark, d, "media_metadata")
    service = F.concat(F.lit("https://img.example.invalid/iiif/"), urls.quoted(F.col("id"), ""))
    return media.select("meta_row", urls.iiif_url(service, F.col("width"), F.col("height"), 1024).alias("url"), urls.thumbnail_url("https://files.example.invalid", F.col("id"), F.col("width"), 960).alias("thumb"))


@query("select meta_row, concat_ws('_', substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), substr(md5(title), 1, 8)) as slug from media_metadata where title is not null")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Names for files from titles."""
    return read_table(spark, d, "media_metadata").where("title is not null").select("meta_row", X.slug(F.col("title")).alias("slug"))


@query("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents where text is not null")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of texts."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""with l as (select user_id, list(event_type order by event_id) as a from events group by 1)
    select user_id, array_to_string(list_filter(a, lambda x, i: (i = 1 or x <> a[i - 1]) and x <> 'view'), ',') as runs from l""")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Event types of a user with equal neighbours as one, one type as blank."""
    listed = read_table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("a"))
    return listed.select("user_id", F.array_join(X.runs_collapsed(F.col("a"), F.lit("view")), ",").alias("runs"))


@query("select o_orderkey, date_trunc('month', o_orderdate)::date as month, last_day(o_orderdate) as month_end, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') as stamp from orders")
def date_windows(spark: SparkSession, d: str) -> DataFrame:
    """Month windows and stamps of dates."""
    o = read_table(spark, d, "orders")
    first, last = dates.month_window(F.col("o_orderdate"))
    return o.select("o_orderkey", first.alias("month"), last.alias("month_end"), dates.stamp(F.col("o_orderdate")).alias("stamp"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey % 100 when 1 then greatest(0, epoch(o_orderdate)::bigint - epoch(timestamp '1995-06-01')::bigint) end as seconds from orders""")
def retry_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Pauses that servers ask for, in seconds or by a date."""
    o = read_table(spark, d, "orders")
    kind, at = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("timestamp")
    header = F.when(kind == 0, (F.col("o_orderkey") % 100).cast("string")).when(kind == 1, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    return o.select("o_orderkey", dates.retry_after(header, F.lit("1995-06-01").cast("timestamp")).alias("seconds"))


@query("""with c as (select docket, date_argued as a, least(date_argued + 100, date '2030-06-15') as b from argued_cases where date_argued is not null and docket is not null), m as (select docket, a, b, unnest(generate_series(date_trunc('month', a)::timestamp, date_trunc('month', b)::timestamp, interval 1 month))::date as m from c where a <= b)
    select docket, greatest(m, a) as start, least(last_day(m), b) as "end" from m""")
def month_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of months between two dates."""
    c = read_table(spark, d, "argued_cases").where("date_argued is not null and docket is not null")
    w = dates.windows_of_months(F.col("date_argued"), F.least(F.date_add("date_argued", 100), F.lit("2030-06-15").cast("date")))
    return c.select("docket", F.explode(w).alias("w")).select("docket", "w.start", "w.end")


@query()
def subword_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts as ids of a public sentencepiece model, with the clip's slots."""
    seg = read_table(spark, d, "segments").select("seg_row", "text_normalized", F.when(F.col("duration_s").between(0, 1e5), F.ceil(F.col("duration_s") * 2.5).cast("int")).alias("slots"), (F.col("seg_row") % 2 == 0).alias("made"))
    ids = seg.withColumn("ids", multimodal.subword_ids(spark, F.col("text_normalized"), f"{TOKENIZERS}/piece_bpe_32k.model")).drop("text_normalized")
    rows = multimodal.training_rows(ids, "ids", "slots", "made", multimodal.Marks(32000, 32001, 32002, 32003))
    return rows.select("seg_row", "input_ids", "modality_ids", "loss_mask")


@query()
def spoken_forms(spark: SparkSession, d: str) -> DataFrame:
    """Texts in the words they are spoken with."""
    return spread(read_table(spark, d, "segments").select("seg_row", "text_original")).select("seg_row", spoken.normalise(F.col("text_original")).alias("spoken"))


@query()
def token_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """All readings of the tokens with digits."""
    tokens = read_table(spark, d, "segments").select(F.explode(X.words(F.col("text_original"))).alias("token")).where(F.col("token").rlike("[0-9]")).groupBy("token").count()
    return tokens.select("token", "count", spoken.token_readings(F.col("token"), F.lit(None).cast("string")).alias("readings"))


#: Small lexicons of the query; larger ones are tables.
SEEN = "red blue green yellow black white gold silver dark bright wood metal glass paper stone round oval square left right foreground background portrait landscape window tree river hill boat bridge lamp door figure face hat coat".split()
TOLD = "born died war founded established served worked married donated gift purchased exhibited museum history known famous company century period during years family published award was were had would became began".split()


def _sql_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# a mark after an abbreviation or an initial gets a sign behind it (twice, as neighbours share their space), so no boundary is seen there
_ABBREVIATED = rf"(?i)(^|\s)({'|'.join(x.replace('.', chr(92) + '.') for x in visual.ABBREVIATIONS)}|[a-z])([.!?])(\s)"
_MARKED = f"regexp_replace(regexp_replace(para, '{_ABBREVIATED}', '\\1\\2\\3\x01\\4', 'g'), '{_ABBREVIATED}', '\\1\\2\\3\x01\\4', 'g')"
_VISUAL = rf"""with p as (select meta_row, description, unnest(string_split(description, chr(10) || chr(10))) as para, generate_subscripts(string_split(description, chr(10) || chr(10)), 1) as pi from media_metadata where description <> ''),
    c as (select meta_row, description, pi, string_split(regexp_replace({_MARKED}, '([.!?]["”’)]?)\s+(["“(]?[A-Z0-9])', '\1\x02\2', 'g'), chr(2)) as parts from p),
    s as (select meta_row, description, pi, replace(trim(unnest(parts)), chr(1), '') as s, generate_subscripts(parts, 1) as si from c),
    w as (select *, regexp_extract_all(s, '([A-Za-z][A-Za-z''\-]*|\d+(?:st|nd|rd|th)?s?)', 1) as w from s where s <> ''),
    k as (select *, list_transform(w, lambda x: case when lower(x) in {_sql_list(SEEN)} then 1.0 when lower(x) in {_sql_list(visual.PRESENT)} then 0.5 when regexp_full_match(lower(x), '(?:1[0-9]{{3}}|20[0-2][0-9])s?') then -1.5 when lower(x) in {_sql_list(TOLD)} then -1.0
            when lower(x) in {_sql_list(visual.STRONG_PRONOUNS)} then -1.0 when lower(x) in {_sql_list(visual.WEAK_PRONOUNS)} then -0.5 when ends_with(lower(x), 'ed') and length(x) > 4 then -0.5 end) as k from w),
    t as (select meta_row, description, pi, si, s, len(w) as n, (coalesce(list_sum(k), 0) - 0.5 * least(3, len(list_filter(w, lambda x, i: i > 1 and regexp_matches(x, '^[A-Z]') and k[i] is null))) - len(regexp_extract_all(s, '(?i)\b\d+(?:st|nd|rd|th)[- ]century\b')))::double as x from k),
    r as (select *, x / greatest(n, 1) as rate, sum(x) over (partition by meta_row, pi) / greatest(sum(n) over (partition by meta_row, pi), 1) as whole from t),
    g as (select meta_row, pi, string_agg(s, ' ' order by si) as kept from r where case when whole > 0.05 then rate > -0.15 else rate >= 0.15 end group by all),
    o as (select meta_row, string_agg(kept, chr(10) || chr(10) order by pi) as text from g group by 1)
    select m.meta_row, o.text, case when m.description <> '' then least(coalesce(length(o.text), 0) / length(m.description), 1.0)::float end as retained from media_metadata m left join o using (meta_row)""".replace("\\x02", "\x02")


@query(_VISUAL)
def visual_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The visual sentences of the descriptions."""
    media = read_table(spark, d, "media_metadata").select("meta_row", visual.visual_text(F.col("description"), visual.VisualText(SEEN, TOLD)).alias("v"))
    return media.select("meta_row", "v.text", "v.retained")


@query("select docket, date_argued, line_no, line from (select docket, date_argued, ingested_at, unnest(string_split(transcript, chr(10))) as line, generate_subscripts(string_split(transcript, chr(10)), 1) as line_no from argued_cases)")
def line_explode(spark: SparkSession, d: str) -> DataFrame:
    """Lines of transcripts with their numbers."""
    return Sp.explode_lines(read_table(spark, d, "argued_cases").select("docket", "date_argued", "transcript"), "transcript").select("docket", "date_argued", F.col("line_no").cast("long").alias("line_no"), "line")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    cases = Wn.first_occurrence(read_table(spark, d, "argued_cases").where("transcript is not null"), "docket", ["ingested_at"])
    return Sp.parse_turns(cases, ["docket", "date_argued"], "transcript")


_TURNS = r"""with c as (select docket, date_argued, transcript from (select *, row_number() over (partition by docket order by ingested_at) as rn from argued_cases where transcript is not null) where rn = 1),
    l as (select docket, date_argued, unnest(string_split(transcript, chr(10))) as line, generate_subscripts(string_split(transcript, chr(10)), 1) as n from c),
    s as (select docket, date_argued, n, trim(regexp_replace(regexp_replace(line, '(?i)\((?:laughter|pause|nods|indicating|inaudible|crosstalk|applause)[^)]*\)', '', 'g'), '[\s\x{a0}]+', ' ', 'g')) as line from l),
    k as (select *, regexp_extract(line, '^(unknown|[A-Z](?:\p{L}|[.''’&/ -]){1,43}):', 1) as p from s where line <> '' and not (regexp_full_match(line, '[(\[{][^(){}\[\]]+[}\])]\.*') and regexp_matches(line, '\p{Ll}') and regexp_matches(line, '[ .]'))),
    m as (select *, case when p = 'unknown' or (length(regexp_replace(p, '\P{L}', '', 'g')) >= 2 and length(regexp_replace(p, '\P{Lu}', '', 'g')) >= 0.6 * length(regexp_replace(p, '\P{L}', '', 'g'))) then p end as label,
                 regexp_matches(line, '^(?:(?:ORAL|REBUTTAL|REDIRECT|CONTINUED|FURTHER)\s+)*ARGUMENT\s+(?:OF|BY)\b|^ON\s+BEHALF\s+OF\b') or (not contains(line, ':') and not regexp_matches(line, '\p{Ll}') and length(regexp_replace(line, '\P{L}', '', 'g')) >= 4 and contains(line, ' ')) as heading from k),
    t as (select docket, date_argued, n, label, case when label is not null then regexp_replace(line, '^[^:]*:\s*', '') else line end as said, heading, sum(case when heading and contains(line, 'ARGUMENT') then 1 else 0 end) over w as section, sum(case when label is not null then 1 else 0 end) over w as turn from m window w as (partition by docket, date_argued order by n)),
    g as (select docket, date_argued, turn, min(section) as section, coalesce(max(label), 'UNIDENTIFIED') as speaker, regexp_replace(regexp_replace(trim(regexp_replace(string_agg(said, ' ' order by n), '\s+', ' ', 'g')), '(\s)-$', '\1--'), '([^\s-])-$', '\1 --') as text, min(n) as line_start from t where not heading group by all),
    turns as (select docket, date_argued, row_number() over (partition by docket, date_argued order by turn) - 1 as turn, section::bigint as section, speaker, text, line_start::int as line_start from g where text <> '')"""


@query(_TURNS + " select * from turns")
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the transcripts."""
    return _turns(spark, d)


@query(_TURNS + """, r as (select t.*, b.name from turns t left join bench b on upper(t.speaker) = upper(b.name) and t.date_argued >= b.start_date and t.date_argued <= coalesce(b.end_date, date '9999-12-31'))
    select docket, turn, speaker, case when name is not null then 'highcourt:' || upper(name) end as justice from r where name is not null""")
def seated_justices(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the justices seated on the day, by the resolution of all labels."""
    turns = _turns(spark, d)
    bench = read_table(spark, d, "bench")
    resolved = Sp.resolve_speakers(turns, "speaker", "date_argued", bench, "highcourt")
    return resolved.where((F.col("role") == "justice") & (F.col("speaker_id") == F.concat(F.lit("highcourt:"), F.upper("speaker")))).select("docket", "turn", "speaker", F.col("speaker_id").alias("justice"))


@query()
def resolved_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Turns with speaker id and role; advocates by the appearances that their transcript lists."""
    cases = read_table(spark, d, "argued_cases").where("transcript is not null")
    named = Sp.appearances(cases, ["docket"], "transcript")
    return Sp.resolve_speakers(_turns(spark, d), "speaker", "date_argued", read_table(spark, d, "bench"), "highcourt", "docket", named)


@query()
def transcript_texts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts put together again from their turns, after repair of wrong attributions, which are listed."""
    resolved = Sp.resolve_speakers(_turns(spark, d), "speaker", "date_argued", read_table(spark, d, "bench"), "highcourt")
    fixed = Wn.repair_sandwiched(resolved, ["docket"], "turn", "speaker", "section", allowed=F.col("role") != "advocate")
    return Sp.transcript_text(fixed.withColumnsRenamed({"speaker": "was", "repaired": "speaker"}), ["docket"], was="was")


@query(_TURNS + " select docket, string_agg(speaker || ': ' || text, chr(10) order by turn) as transcript, count(*) as n_turns from turns group by docket")
def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts put together again from their turns."""
    return Sp.transcript_text(_turns(spark, d), ["docket"]).select("docket", "transcript", "n_turns")


@query(_TURNS + """, w as (select docket, turn, speaker, string_split(text, ' ') as w, row_number() over (partition by docket order by turn) - 1 as i from turns)
    select docket, flatten(list(w order by turn)) as tokens, flatten(list(list_transform(w, lambda x: cast(i as int)) order by turn)) as turn_idx, flatten(list(list_transform(w, lambda x: speaker) order by turn)) as speakers from w group by docket""")
def turn_token_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of the transcripts as arrays with their turns and speakers."""
    return Sp.token_arrays(_turns(spark, d), ["docket"]).select("docket", "tokens", "turn_idx", "speakers")


@query(_TURNS + """, w as (select docket, turn, speaker, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) - 1 as token_no from turns)
    select docket, turn, speaker, cast(token_no as int) as token_no, token from w""")
def turn_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the turns."""
    return Sp.flatten_tokens(_turns(spark, d), ["docket"])


@query()
def speech_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of recordings: each record's tokens, timed evenly, cut under a cap, trimmed and padded."""
    seg = read_table(spark, d, "segments").where("docket is not null").select("docket", "seg_row", F.col("speaker_id").alias("speaker"), F.when(~F.isnan("avg_word_score"), F.col("avg_word_score")).alias("s"), "text_original", "start_s", "end_s")
    timed = Sp.timed_tokens(seg, ["docket", "seg_row", "speaker", "s"], "text_original", "start_s", "end_s")
    t = timed.withColumnsRenamed({"docket": "rec", "seg_row": "turn", "token_no": "place"})
    t = t.withColumns({"count": F.char_length("token"), "score": F.col("s") * F.char_length("token"), "content": F.lit(True), "ok": F.col("s").isNotNull(), "unspoken": F.col("start").isNull()})
    numbered = t.withColumn("token_no", F.row_number().over(Window.partitionBy("rec").orderBy("start", "turn", "place"))).drop("place", "s")
    return Sp.segments(numbered, ["rec"], F.lit(1e6), Sp.SegmentRules(cap=20.0, max_pause=2.0))


@query()
def segmented_turns(spark: SparkSession, d: str) -> DataFrame:
    """Segments of timed tokens under a cap."""
    tokens = Sp.timed_tokens(read_table(spark, d, "segments"), ["seg_row"], "text_original", "start_s", "end_s")
    return Sp.segment_turns(tokens, ["seg_row"], 20.0, 2.0)


@query()
def aligned_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors between original and normalised texts."""
    return Sp.align_tokens(read_table(spark, d, "segments"), "seg_row", "text_original", "text_normalized")


@query("""select min(len(list_filter(string_split(trim(regexp_replace(transcript, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) / nullif(duration_s, 0)) as lo, max(len(list_filter(string_split(trim(regexp_replace(transcript, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) / nullif(duration_s, 0)) as hi from argued_cases where transcript is not null""")
def words_per_second(spark: SparkSession, d: str) -> DataFrame:
    """Slowest and fastest transcript."""
    w = Sp.words_per_second(F.col("transcript"), F.col("duration_s"))
    return read_table(spark, d, "argued_cases").where("transcript is not null").agg(F.min(w).alias("lo"), F.max(w).alias("hi"))


@query(r"""select seg_row, 'nulls' as "check" from segments where audio.bytes is null or text_original is null or speaker_id is null or avg_word_score is null
    union all select seg_row, 'bad_times' from segments where end_s <= start_s or duration_s <= 0 or abs(duration_s - (end_s - start_s)) > 0.002
    union all select seg_row, 'over_cap' from segments where duration_s > 25.001
    union all select seg_row, 'no_alphanumeric' from segments where not regexp_matches(text_original, '[A-Za-z0-9]')
    union all select seg_row, 'stage_leak' from segments where regexp_matches(text_original, '(?i)\((?:laughter|pause|nods|indicating|inaudible|crosstalk)')
    union all select seg_row, 'label_leak' from segments where regexp_matches(text_original, '\b(?:CHIEF JUSTICE|JUSTICE|GENERAL|MRS?\.|MS\.) [A-Z]{3,}[A-Z''-]*:')""")
def violations_report(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of the row checks."""
    return V.violations(read_table(spark, d, "segments"), V.segment_rules(), ["seg_row"])


@query("select docket, start_s, count(*) as n from segments group by all having count(*) > 1")
def duplicate_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts that occur more than once in a docket."""
    return V.duplicates(read_table(spark, d, "segments"), ["docket", "start_s"])


@query(r"""with c as (select duration_s as d, len(list_filter(string_split(trim(regexp_replace(text_original, '[\s\x{a0}]+', ' ', 'g')), ' '), lambda w: w <> '')) as w, len(regexp_extract_all(text_original, '[A-Za-z0-9'']+')) as s from segments)
    select count(*) as n, count(*) filter (d < 0.3) / count(*) as tiny, count(*) filter (d > 3 and w / d < 1.0) / count(*) as slow, count(*) filter (d > 1 and s / d > 8.0) / count(*) as fast from c""")
def segment_rates(spark: SparkSession, d: str) -> DataFrame:
    """Shares of segments that are too short, slow or fast."""
    return V.rates(read_table(spark, d, "segments"))


@query("""with e as (select 'c' || c_custkey as child, 'n' || c_nationkey as parent from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation), r as (select 'c' || c_custkey as root from customer)
    select root, root as node, 0 as depth from r union all select root, parent, 1 from r join e on root = child union all select root, f.parent, 2 from r join e on root = e.child join e f on e.parent = f.child""")
def ancestry_closure(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of all customers with their depth."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = read_table(spark, d, "customer").select(text("c", "c_custkey").alias("child"), text("n", "c_nationkey").alias("parent")).union(read_table(spark, d, "nation").select(text("n", "n_nationkey"), text("r", "n_regionkey")))
    roots = read_table(spark, d, "customer").select(text("c", "c_custkey").alias("root"))
    return L.ancestry(edges, roots)


@query(f"""select id, license, creator, title, image_url, width, height, is_alt_image, license_raw, artwork_id from (
    select id, 'PD' as license, 'is_public_domain' as license_raw, creator, title, case when width <= 843 then 'https://iiif.example.invalid/' || url_encode(id) || '/full/full/0/default.jpg' else 'https://iiif.example.invalid/' || url_encode(id) || '/full/843,/0/default.jpg' end as image_url,
           width, height, false as is_alt_image, meta_row as artwork_id from media_metadata where license = 'PD')""")
def artwork_records(spark: SparkSession, d: str) -> DataFrame:
    """Artworks flattened from JSON made of the harvested records."""
    media = read_table(spark, d, "media_metadata")
    made = media.select(F.to_json(F.struct(F.col("meta_row").alias("id"), (F.col("license") == "PD").alias("is_public_domain"), F.col("id").alias("image_id"), F.struct("width", "height").alias("thumbnail"), F.col("creator").alias("artist_display"), "title")).alias("value"))
    flat = R.artworks(made, "PD", "https://iiif.example.invalid", "https://site.example.invalid", 843)
    return flat.select("id", "license", "creator", "title", "image_url", "width", "height", "is_alt_image", "license_raw", "artwork_id")


@query("""select meta_row::varchar as id, case license when 'PD' then 'PD' else 'CC0' end as license, nullif(creator, '') as creator, image_url, width, height, list_distinct([coalesce(title, 'none'), 'other']) [1] is not null as tagged
    from media_metadata where license in ('PD', 'CC0') and image_url <> ''""")
def holding_records(spark: SparkSession, d: str) -> DataFrame:
    """Museum objects flattened from JSON made of the harvested records."""
    media = read_table(spark, d, "media_metadata")
    rights = F.struct(F.col("license").alias("title"), F.lit(True).alias("allowsDownload"))
    medium = F.struct(F.col("meta_row").alias("id"), F.lit("ImageObject").alias("type"), F.col("image_url").alias("previewUrl"), "width", "height", rights.alias("rights"))
    object_ = F.struct(F.col("meta_row").alias("id"), F.lit("Object").alias("type"), "title", F.array(F.struct(F.struct(F.col("creator").alias("title")).alias("contributor"))).alias("production"), F.array(F.struct(F.coalesce("title", F.lit("none")).alias("title"))).alias("depicts"), F.array(medium).alias("hasRepresentation"))
    flat = R.holdings(media.select(F.to_json(object_).alias("value")), {"PD": "PD", "CC0": "CC0"}, "https://site.example.invalid")
    return flat.select("id", "license", F.when(F.col("creator") != "", F.col("creator")).alias("creator"), "image_url", "width", "height", (F.size("categories") > 0).alias("tagged"))


@query("""select doc_id, lang, row_number() over (order by doc_id) - 1 as row, 'doc:' || doc_id as id from documents where lower(trim(lang)) = 'en' and n_chars > 100 and n_chars < 3000""")
def pipeline_recipe(spark: SparkSession, d: str) -> DataFrame:
    """A declarative recipe with an overlay."""
    recipe = Pipeline(
        {"source": {"format": "parquet", "files": f"{d}/documents.parquet"}, "pipeline": {"pick": {"type": "select_columns", "columns": ["doc_id", "lang", "n_chars"]}, "english": {"type": "matching", "columns": ["lang"], "values": ["EN"]}, "length": {"type": "range", "columns": ["n_chars"], "low": 0, "high": 3000}, "number": {"type": "row_index", "order_by": ["doc_id"]}}},
        {"pipeline": {"length": {"low": 100}, "prefix": {"type": "constants", "values": {"prefix": "doc"}, "$after": "pick"}, "id": {"type": "composite_id", "columns": ["constant", "doc_id"], "$after": "number"}}},
        sets=["pipeline.id.columns=[prefix, doc_id]"],
    )
    return recipe.apply(recipe.source(spark)).select("doc_id", "lang", "row", "id")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return file_stream(spark, f"{d}/events.parquet", read_table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _all_of(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives when it has read everything there is, through a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4()}"
    write = lambda df, epoch: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("select event_id, user_id, event_type from events")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Events once each, incrementally."""
    return _all_of(streams.deduplicated(_stream(spark, d), "event_id", "ts", "1 hour").select("event_id", "user_id", "event_type"), "append")


@query("select event_type, time_bucket(interval '6 hours', ts) as start, count(*) as n from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by six-hour windows, incrementally."""
    counts = _all_of(streams.windowed_counts(_stream(spark, d), "ts", "1 day", "6 hours", "event_type"), "complete")
    return counts.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")
