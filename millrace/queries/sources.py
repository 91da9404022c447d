"""Queries of scans, harvested records, sinks and media rows. What they scan is made of the test tables and written to the shared folder first."""

from __future__ import annotations

import io
import tarfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import media, multimodal, spoken, visual
from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import joins as J
from millrace.operators import lineage as L
from millrace.operators import records as R
from millrace.operators import sampling as S
from millrace.operators import speech as Sp
from millrace.queries import Registry
from millrace.session import read_table, shared_folder
from millrace.sources import files, paged, sinks

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/made/{uuid.uuid4()}"


@query("select r_regionkey, r_name from region union all select r_regionkey, r_name from region")
def combined_split_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two splits read by one name."""
    return files.scan_splits(spark, d, "region.parquet+region.parquet").select("r_regionkey", "r_name")


@query("select o_orderkey, o_totalprice from orders")
def index_without_source(spark: SparkSession, d: str) -> DataFrame:
    """An index that has all wanted columns: the source isn't read."""
    index, source = files.load_indexed(spark, d, "orders.parquet", f"{d}/none.parquet", ["o_orderkey", "o_totalprice"])
    return J.join_index(index, source).select("o_orderkey", "o_totalprice")


@query("select seg_row, case split when 'dev' then 'validation' when 'TRAIN' then 'train' else split end as split from segments where split is not null")
def split_by_value(spark: SparkSession, d: str) -> DataFrame:
    """One split per value, some renamed."""
    return files.split_by_column(read_table(spark, d, "segments").select("seg_row", F.col("split").alias("was")), "was", {"dev": "validation", "TRAIN": "train"}).select("seg_row", "split")


@query("""with m as (select audio.path as path, any_value(audio.bytes) as b from segments where audio.path is not null group by 1)
    select seg_row, audio.path as path, md5(hex(m.b)) as content from segments left join m on audio.path = m.path""")
def media_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Media bytes joined by path."""
    seg = read_table(spark, d, "segments").select("seg_row", "audio")
    stored = seg.where("audio.path is not null").groupBy(F.col("audio.path").alias("p")).agg(F.first("audio.bytes").alias("content")).select(F.concat(F.lit("file:/data/"), "p").alias("path"), "content")
    out = files.with_media(seg.select("seg_row", F.col("audio.path").alias("path")), stored, "path", root="/data")
    return out.select("seg_row", "path", F.md5(F.hex("audio.bytes")).alias("content"))


@query("select s.seg_row, coalesce(c.ms / 1000, s.duration_s) as duration_s from segments s left join (select docket, min(duration_s * 1000) as ms from argued_cases where docket is not null group by 1) c on s.docket = c.docket")
def side_file_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations from a side table in milliseconds, else the row's own."""
    side = read_table(spark, d, "argued_cases").select("docket", (F.col("duration_s") * 1000).alias("ms"))
    seg = read_table(spark, d, "segments").select("seg_row", "docket", F.col("duration_s").alias("own"))
    return files.with_durations(seg, side, "docket", "docket", "ms", F.col("own")).select("seg_row", "duration_s")


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def text_table_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table with a header, all columns text."""
    at = _folder(spark)
    read_table(spark, d, "nation").coalesce(1).write.csv(at, sep="\t", header=True, quote="")
    return files.scan_text_table(spark, at)


@query("select meta_row, license, title from media_metadata where license in ('CC0', 'PD')")
def json_dump_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a JSON array dump, sorted out by marks before they are parsed."""
    at = _folder(spark)
    rows = read_table(spark, d, "media_metadata").select(F.concat(F.to_json(F.struct("meta_row", "license", "title"), {"ignoreNullFields": "false"}), F.lit(",")).alias("value"))
    spark.createDataFrame([("[",), ("]",)], "value string").union(rows).write.option("compression", "gzip").text(at)
    return files.json_lines(spark, at, "meta_row long, license string, title string", ['"license":"CC0"', '"license":"PD"'])


@query("select 'n/' || n_nationkey || '.json' as member, n_name as name from nation where n_regionkey <> 1")
def tar_member_scan(spark: SparkSession, d: str) -> DataFrame:
    """Members of a compressed archive by prefix and suffix."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:bz2") as archive:
        for r in J.bounded_rows(read_table(spark, d, "nation"), 1000, "nation"):
            data = r["n_name"].encode()
            info = tarfile.TarInfo(f"{'x' if r['n_regionkey'] == 1 else 'n'}/{r['n_nationkey']}.json")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    at = f"{_folder(spark)}/a.tar.bz2"
    sinks.write_bytes(spark, out.getvalue(), at)
    return files.tar_members(spark, at, "n/").select("member", F.col("value").alias("name"))


@query("select r_name as unit, n_name as name from nation join region on n_regionkey = r_regionkey")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Units read page by page through a data source."""
    region = {r["r_regionkey"]: r["r_name"] for r in J.bounded_rows(read_table(spark, d, "region"), 1000, "region")}
    held: dict = {}
    for r in J.bounded_rows(read_table(spark, d, "nation"), 1000, "nation"):
        held.setdefault(region[r["n_regionkey"]], []).append({"name": r["n_name"]})

    def request(unit: str, cursor: str | None):
        at = int(cursor or 0)
        return held[unit][at : at + 2], str(at + 2) if at + 2 < len(held[unit]) else None

    got = paged.read_paged(spark, "paged_nations", sorted(held), request)
    return got.select("unit", F.get_json_object("value", "$.name").alias("name"))


@query("""with recursive n as (select o_orderdate::date as day, count(*) as n from orders group by 1),
         w as (select (select min(day) from n) as a, (select max(day) from n) as b
               union all select case side when 0 then a else a + cast((b - a) // 2 as int) + 1 end, case side when 0 then a + cast((b - a) // 2 as int) else b end
               from w, (select unnest([0, 1]) as side) s where (select sum(n.n) from n where n.day between a and b) > 2000 and a < b),
         s as (select a, b, (select sum(n.n) from n where n.day between a and b) as n from w)
    select a as start, b as "end", cast(n as bigint) as n from s where n > 0 and (n <= 2000 or a = b)""")
def bounded_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of days halved until each holds few enough orders; empty ones are left out."""
    days = {r["day"].toordinal(): r["n"] for r in J.bounded_rows(read_table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n")), 100_000, "the days")}
    size = lambda w: sum(days.get(i, 0) for i in range(w[0], w[1] + 1))
    whole = (min(days, default=0), max(days, default=-1))
    units = paged.bounded_units(whole, size, lambda w: paged.halves(*w), 2000)
    import datetime

    rows = [(datetime.date.fromordinal(a), datetime.date.fromordinal(b), size((a, b))) for a, b in units]
    return spark.createDataFrame(rows, "start date, end date, n long")


_XML = """'<record xmlns="http://www.openarchives.org/OAI/2.0/"><header><identifier>' || {0} || '</identifier></header><metadata><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ore="http://www.openarchives.org/ore/terms/" xmlns:edm="http://www.europeana.eu/schemas/edm/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:skos="http://www.w3.org/2004/02/skos/core#">'"""


@query("""select id, license, license_raw, creator, source_url, title, image_url from (select 'r' || meta_row as id, license, license as license_raw, nullif(trim(regexp_replace(creator, '\\s+', ' ', 'g')), '') as creator, source_url, nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') as title, image_url from media_metadata
    where license in ('CC0', 'PD') and image_url is not null)""")
def harvested_records(spark: SparkSession, d: str) -> DataFrame:
    """XML records flattened, made of the harvested records."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    ref = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<edm:{tag} rdf:resource="'), esc(c), F.lit('"/>'))).otherwise("")
    head, tail = _XML.split(" || {0} || ")
    m = read_table(spark, d, "media_metadata").withColumn("rid", F.concat(F.lit("r"), F.col("meta_row").cast("string")))
    xml = F.concat(
        F.lit(head[1:-1]), "rid", F.lit(tail[1:-1]), F.lit('<edm:ProvidedCHO rdf:about="'), "rid", F.lit('"><dc:title xml:lang="en">'), esc("title"), F.lit('</dc:title><dc:creator rdf:resource="c"/></edm:ProvidedCHO><ore:Aggregation>'),
        ref("rights", "license"), ref("isShownBy", "image_url"), ref("isShownAt", "source_url"), F.lit('</ore:Aggregation><edm:Agent rdf:about="c"><skos:prefLabel xml:lang="en">'), esc("creator"), F.lit("</skos:prefLabel></edm:Agent></rdf:RDF></metadata></record>"),
    )
    flat = R.harvested_xml(m.select(xml.alias("value")), {"CC0": "CC0", "PD": "PD"}, ["en", "nl"])
    return flat.select("id", "license", "license_raw", "creator", "source_url", "title", "image_url")


@query("""select 'M' || meta_row as id, case license when 'CC0' then 'CC0' else 'PD-USGov' end as license, creator, title, width, height from (select *, replace(title, ' ', '_') as t from media_metadata) where license in ('CC0', 'PD-USGov')""".replace("creator, title,", "nullif(creator, '') as creator, t as title,"))
def statement_records(spark: SparkSession, d: str) -> DataFrame:
    """Entities of statements: license by statement or by status and determination, sizes, creators."""
    value = lambda v: F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))
    amount = lambda c: F.to_json(F.struct(F.concat(F.lit("+"), F.col(c).cast("string")).alias("amount")))
    item = lambda q: F.lit(f'{{"id":"{q}"}}')
    listed = lambda cond, *v: F.when(cond, F.array(*v))
    gov = F.struct(F.struct(F.struct(item("S1").alias("value")).alias("datavalue")).alias("mainsnak"), F.create_map(F.lit("P459"), F.array(F.struct(F.struct(item("G").alias("value")).alias("datavalue")))).alias("qualifiers"))
    m = read_table(spark, d, "media_metadata")
    statements = F.struct(
        listed(F.col("license") == "CC0", value(item("Q1"))).alias("P275"), listed(F.col("license") == "PD-USGov", gov).alias("P6216"), F.array(value(F.lit("image/jpeg"))).alias("P1163"),
        listed(F.col("width").isNotNull(), value(amount("width"))).alias("P2049"), listed(F.col("height").isNotNull(), value(amount("height"))).alias("P2048"), listed(F.col("creator").isNotNull(), value(F.col("creator"))).alias("P170"),
    )
    lines = m.select(F.to_json(F.struct(F.concat(F.lit("M"), F.col("meta_row").cast("string")).alias("id"), F.col("meta_row").alias("pageid"), F.concat(F.lit("File:"), "title").alias("title"), statements.alias("statements"))).alias("value"))
    flat = R.entity_statements(lines, {"Q1": "CC0"}, {"S1": "PD"}, "G", "PD-USGov", ["image/jpeg"], "https://files.example.invalid", "https://site.example.invalid", 960)
    return flat.select("id", "license", "creator", "title", "width", "height")


@query("""select 'i' || meta_row as id, license, license as license_raw, case when creator <> '' then 'Artist: ' || creator end as creator, case when height > 0 then width end as width, case when width > 0 then height end as height, nullif(trim(regexp_replace(description, '\\s+', ' ', 'g')), '') as description from media_metadata where license = 'CC0'""")
def museum_media(spark: SparkSession, d: str) -> DataFrame:
    """Objects with media; sizes from a resource where the medium has none."""
    m = read_table(spark, d, "media_metadata")
    even = F.col("meta_row") % 2 == 0
    res = F.array(F.struct(F.lit("about").alias("dimensions")), F.struct(F.when(~even, F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))).alias("dimensions")))
    medium = F.struct(F.concat(F.lit("i"), F.col("meta_row").cast("string")).alias("idsId"), F.lit("Images").alias("type"), F.when(even, F.col("width").cast("string")).alias("width"), F.when(even, F.col("height").cast("string")).alias("height"), F.struct(F.col("license").alias("access")).alias("usage"), res.alias("resources"))
    described = F.struct(F.col("meta_row").cast("string").alias("record_ID"), F.struct(F.col("title").alias("content")).alias("title"), F.struct(F.array(medium).alias("media")).alias("online_media"))
    free = F.struct(F.array(F.struct(F.lit("Note").alias("label"), F.col("description").alias("content"))).alias("notes"), F.array(F.struct(F.lit("Artist").alias("label"), F.col("creator").alias("content"))).alias("name"))
    lines = m.select(F.to_json(F.struct(F.struct(described.alias("descriptiveNonRepeating"), free.alias("freetext")).alias("content"))).alias("value"))
    return R.online_media(lines, {"CC0": "CC0"}, ["Images"], ["Note"], "https://ids.example.invalid", 1024).select("id", "license", "license_raw", "creator", "width", "height", "description")


@query("""select 'n' || meta_row as id, 'PD-USGov' as license, coalesce(nullif(creator, ''), 'Center') as creator, case when meta_row % 3 = 0 then 'https://x.example.invalid/a~orig.jpg' else 'https://x.example.invalid/a~thumb.jpg' end as image_url from media_metadata
    where not regexp_matches(lower(coalesce(title, '')), '(^|[^\\w])(bridge|vase)([^\\w]|$)') and not regexp_matches(lower(coalesce(creator, '')), '(^|[^\\w])(bridge|vase)([^\\w]|$)')""")
def library_records(spark: SparkSession, d: str) -> DataFrame:
    """Library items without excluded terms, the largest image that there is."""
    m = read_table(spark, d, "media_metadata")
    link = lambda size, there: F.when(there, F.struct(F.lit(f"http://x.example.invalid/a~{size}.jpg").alias("href"), F.lit("image").alias("render")))
    data = F.array(F.struct(F.concat(F.lit("n"), F.col("meta_row").cast("string")).alias("nasa_id"), F.lit("image").alias("media_type"), "title", F.col("creator").alias("photographer"), F.lit("Center").alias("center")))
    links = F.array_compact(F.array(link("thumb", F.lit(True)), link("orig", F.col("meta_row") % 3 == 0)))
    return R.library_items(m.select(F.to_json(F.struct(data.alias("data"), links.alias("links"))).alias("value")), "PD-USGov", "raw", "https://s.example.invalid", ["orig", "thumb"], ["bridge", "vase"]).select("id", "license", "creator", "image_url")


@query("""select meta_row::varchar as id, license, case when creator <> '' and not regexp_matches(creator, '^https?://') then creator end as creator, coalesce(case when meta_row % 2 = 0 then image_url end, image_url) as image_url, 'nl' as text_language from media_metadata where license in ('CC0', 'PD') and image_url is not null""")
def aggregated_records(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated records; the image from the preview's query where none is shown."""
    m = read_table(spark, d, "media_metadata")
    texts = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.array(c).alias("nl"), F.array(F.lit("other")).alias("fr")))
    shown, preview = F.when(F.col("meta_row") % 2 == 0, F.array("image_url")), F.array(F.concat(F.lit("https://t.example.invalid/i?uri="), F.url_encode("image_url"), F.lit("&type=IMAGE")))
    record = F.struct(F.concat(F.lit("/"), F.col("meta_row").cast("string")).alias("id"), F.when(F.col("license").isNotNull(), F.array("license")).alias("rights"), F.array(F.lit("D")).alias("dataProvider"), F.array(F.lit("nl")).alias("language"), shown.alias("edmIsShownBy"), preview.alias("edmPreview"), texts("creator").alias("dcCreatorLangAware"))
    return R.aggregated(m.select(F.to_json(record).alias("value")), {"CC0": "CC0", "PD": "PD"}, "https://s.example.invalid").select("id", "license", "creator", "image_url", "text_language")


@query("""select meta_row::varchar as id, license, nullif(creator, '') as creator, width, height, case when meta_row % 2 = 0 then 'en' else 'da' end as text_language from media_metadata where license in ('CC0', 'PD') and image_url <> ''""")
def gallery_records(spark: SparkSession, d: str) -> DataFrame:
    """Gallery works with the title in the preferred language."""
    m = read_table(spark, d, "media_metadata")
    danish = F.struct(F.lit("Dansk").alias("title"), F.lit("dansk").alias("language"))
    titles = F.when(F.col("meta_row") % 2 == 0, F.array(danish, F.struct(F.lit("English").alias("title"), F.lit("Engelsk").alias("language")))).otherwise(F.array(danish))
    work = F.struct(F.col("meta_row").cast("string").alias("object_number"), F.col("license").alias("rights"), F.lit(True).alias("public_domain"), F.col("image_url").alias("image_thumbnail"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), titles.alias("titles"), F.array(F.struct("creator"), F.struct("creator")).alias("production"))
    return R.gallery_works(m.select(F.to_json(work).alias("value")), {"CC0": "CC0", "PD": "PD"}, {"engelsk": "en", "dansk": "da"}, ["en", "da"]).select("id", "license", "creator", "width", "height", "text_language")


@query("""select case_name as name, page_url as link, docket, strftime(date_argued, '%m/%d/%y') as argued from argued_cases where page_url is not null and case_name is not null and docket is not null and date_argued is not null""")
def case_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest over list pages and the pages they link to."""
    cases = read_table(spark, d, "argued_cases").where("page_url is not null and case_name is not null and docket is not null and date_argued is not null")
    item = F.concat(F.lit('<a href="'), "page_url", F.lit('">'), F.replace("case_name", F.lit("&"), F.lit("&amp;")), F.lit("</a>"))
    pages = cases.groupBy("term").agg(F.array_join(F.collect_list(item), " ").alias("html")).select(F.concat(F.lit("https://list.example.invalid/"), F.coalesce(F.col("term").cast("string"), F.lit("none"))).alias("url"), "html")
    one = cases.groupBy("page_url").agg(F.max(F.struct("docket", "date_argued")).alias("c"))
    details = one.select(F.col("page_url").alias("url"), F.concat(F.lit("<b>docket</b><i>"), "c.docket", F.lit("</i><b>argued</b><i>"), F.date_format("c.date_argued", "MM/dd/yy"), F.lit("</i>")).alias("html"))
    return files.linked_manifest(pages, "url", "html", '<a href="([^"]+)">([^<]+)</a>', 1, ["href", "name"], details, "<b>([^<]+)</b><i>([^<]+)</i>").select("name", "link", "docket", "argued")


@query("select doc_id, n_chars, coalesce(lang, '__none') as lang from documents")
def written_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits written in shards by bytes and read back."""
    at = _folder(spark)
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars", F.coalesce("lang", F.lit("__none")).alias("lang"))
    sinks.write_splits(docs.where("lang <> 'de'"), at, "lang", target_mb=1, order_by=["doc_id"])
    sinks.write_splits(docs.where("lang = 'de'"), at, "lang", target_mb=1, add=True)
    return spark.read.parquet(at).select("doc_id", "n_chars", "lang")


@query("select doc_id, case when doc_id % 2 = 0 then 'even' else 'odd' end as unit from documents")
def resumed_units(spark: SparkSession, d: str) -> DataFrame:
    """Units written one by one, the rest of them after a stop."""
    at = _folder(spark)
    docs = read_table(spark, d, "documents").select("doc_id")
    read = lambda u: docs.where(f"doc_id % 2 = {0 if u == 'even' else 1}")
    sinks.ingest_units(spark, ["even"], read, at)
    sinks.ingest_units(spark, ["even", "odd"], read, at)
    return spark.read.parquet(at).select("doc_id", "unit")


@query("select n_nationkey, n_name, case when n_regionkey = 0 then 'first' else 'rest' end as split from nation")
def cached_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits built once and read from then on."""
    at = _folder(spark)
    nation = read_table(spark, d, "nation")
    build = {"first": lambda: nation.where("n_regionkey = 0").drop("n_regionkey"), "rest": lambda: nation.where("n_regionkey <> 0").drop("n_regionkey")}
    sinks.cached(spark, at, build)
    return sinks.cached(spark, at, build).select("n_nationkey", "n_name", "split")


@query("select text_normalized as text, count(*)::varchar as n from segments where text_normalized <> '' and not regexp_matches(text_normalized, '[\t\r\n]') group by 1")
def frequency_table(spark: SparkSession, d: str) -> DataFrame:
    """Text counts written with tabs and read back as text."""
    at = _folder(spark)
    counts = A.text_frequency(read_table(spark, d, "segments").where("not text_normalized rlike '[\\\\t\\\\r\\\\n]'"), "source", "text_normalized").groupBy("text").agg(F.sum("n").alias("n"))
    sinks.write_frequencies(counts, at)
    return spark.read.csv(at, sep="\t", quote="", escape="", schema="text string, n string")


@query("select p_brand as key, row_number() over (order by p_brand) - 1 as id from (select distinct p_brand from part)")
def id_map_table(spark: SparkSession, d: str) -> DataFrame:
    """A dense map of ids written, read back and checked."""
    at = _folder(spark)
    part = read_table(spark, d, "part").select(F.lit(1).alias("source"), "p_brand")
    sinks.write_id_map(A.dense_ids(part, "source", "p_brand"), at)
    return sinks.read_id_map(spark, at)


@query("""with p as (select n_name, row_number() over (order by n_nationkey) as i from nation where n_regionkey = 0)
    select 'flowchart BT' || chr(10) || '  n0["region<br/>2031-01-02"]' || chr(10) || string_agg('  n' || i || '["' || n_name || '"]' || chr(10) || '  class n' || i || ' leaf', chr(10) order by i) || chr(10)
        || string_agg('  n' || i || ' --> n0', chr(10) order by i) || chr(10) || '  classDef leaf stroke-dasharray: 4 4' as graph from p""")
def lineage_graph(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors as Mermaid text."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    record = read_table(spark, d, "nation").where("n_regionkey = 0").agg(names.alias("datasets")).select(F.lit("region").alias("name"), F.lit("2031-01-02T00:00").alias("produced_on"), "datasets")
    return spark.createDataFrame([(L.mermaid(record, "region"),)], "graph string")


@query(r"""with w as (select seg_row, list_filter(regexp_split_to_array(upper(coalesce(text_normalized, '')), '[^\p{L}\p{N}'']+'), lambda x: x <> '') as r, list_filter(regexp_split_to_array(upper(coalesce(text_original, '')), '[^\p{L}\p{N}'']+'), lambda x: x <> '') as h from segments)
    select seg_row, list_sort(list_distinct(list_filter(r, lambda x: not list_contains(h, x)))) as words from w""")
def unspoken_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text that another one lacks."""
    return read_table(spark, d, "segments").select("seg_row", F.array_sort(visual.unspoken_words(F.col("text_normalized"), F.col("text_original"))).alias("words"))


@query("select l_orderkey, l_linenumber, cast(l_linenumber as int) as value from lineitem")
def roman_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of roman numerals."""
    roman = F.element_at(F.array(*[F.lit(x) for x in "I II III IV V VI VII VIII IX X".split()]), F.col("l_linenumber").cast("int"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.roman_value(roman).alias("value"))


_SMALL = "['ZERO', 'ONE', 'TWO', 'THREE', 'FOUR', 'FIVE', 'SIX', 'SEVEN', 'EIGHT', 'NINE', 'TEN', 'ELEVEN', 'TWELVE', 'THIRTEEN', 'FOURTEEN', 'FIFTEEN', 'SIXTEEN', 'SEVENTEEN', 'EIGHTEEN', 'NINETEEN']"
_TENS = "['TWENTY', 'THIRTY', 'FORTY', 'FIFTY', 'SIXTY', 'SEVENTY', 'EIGHTY', 'NINETY']"
_UNDER_100 = f"case when {{0}} < 20 then {_SMALL}[{{0}} + 1] else {_TENS}[{{0}} // 10 - 1] || case when {{0}} % 10 = 0 then '' else ' ' || {_SMALL}[{{0}} % 10 + 1] end end"
_UNDER_1000 = f"case when {{0}} >= 100 then {_SMALL}[{{0}} // 100 + 1] || ' HUNDRED' || case when {{0}} % 100 = 0 then '' else ' ' || ({_UNDER_100.format('({0} % 100)')}) end else {_UNDER_100} end"


@query(f"select o_orderkey, case when o_orderkey >= 1000 then ({_UNDER_1000.format('(o_orderkey // 1000)')}) || ' THOUSAND' || case when o_orderkey % 1000 = 0 then '' else ' ' || ({_UNDER_1000.format('(o_orderkey % 1000)')}) end else ({_UNDER_1000.format('o_orderkey')}) end as words from orders")
def spelled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Cardinal words of numbers."""
    return read_table(spark, d, "orders").select("o_orderkey", spoken.spelled(F.col("o_orderkey")).alias("words"))


_YEAR = f"case when {{0}} >= 2010 then 'TWENTY ' || ({_UNDER_100.format('({0} - 2000)')}) when {{0}} >= 2000 then 'TWO THOUSAND' || case when {{0}} = 2000 then '' else ' ' || {_SMALL}[{{0}} - 1999] end when {{0}} = 1900 then 'NINETEEN HUNDRED' when {{0}} < 1910 then 'NINETEEN OH ' || {_SMALL}[{{0}} - 1899] else 'NINETEEN ' || ({_UNDER_100.format('({0} - 1900)')}) end"


@query(f"select o_orderkey, {_YEAR.format('year(o_orderdate)')} || ' ' || ({_SMALL}[month(o_orderdate) + 1]) || ' POINT ' || ({_SMALL}[day(o_orderdate) % 10 + 1]) as said from orders")
def spoken_dates(spark: SparkSession, d: str) -> DataFrame:
    """Years, numbers and decimals as they are said."""
    written = F.concat_ws(" ", F.year("o_orderdate").cast("string"), F.concat(F.month("o_orderdate").cast("string"), F.lit("."), (F.dayofmonth("o_orderdate") % 10).cast("string")))
    return read_table(spark, d, "orders").select("o_orderkey", spoken.normalise(written).alias("said"))


_ORDINALS = "['ZEROTH', 'FIRST', 'SECOND', 'THIRD', 'FOURTH', 'FIFTH', 'SIXTH', 'SEVENTH', 'EIGHTH', 'NINTH', 'TENTH', 'ELEVENTH', 'TWELFTH', 'THIRTEENTH', 'FOURTEENTH', 'FIFTEENTH', 'SIXTEENTH', 'SEVENTEENTH', 'EIGHTEENTH', 'NINETEENTH']"


@query(f"""with d as (select o_orderkey, day(o_orderdate) as n from orders)
    select o_orderkey, case when n < 20 then {_ORDINALS}[n + 1] when n % 10 = 0 then case n when 20 then 'TWENTIETH' else 'THIRTIETH' end else {_TENS}[n // 10 - 1] || ' ' || {_ORDINALS}[n % 10 + 1] end as said from d""")
def spoken_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Days as ordinals."""
    n = F.dayofmonth("o_orderdate")
    end = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")
    return read_table(spark, d, "orders").select("o_orderkey", spoken.normalise(F.concat(n.cast("string"), end)).alias("said"))


@query(f"""with k as (select distinct docket, regexp_extract(docket, '^(\\d{{1,2}})-', 1)::int as a, regexp_extract(docket, '-(\\d{{3,4}})$', 1)::int as b from argued_cases where regexp_full_match(docket, '\\d{{1,2}}-\\d{{3,4}}'))
    select docket, ({_UNDER_100.format('a')}) || ' ' || ({_UNDER_100.format('(b // 100)')}) || ' ' || case when b % 100 = 0 then 'HUNDRED' when b % 100 < 10 then 'OH ' || {_SMALL}[b % 100 + 1] else ({_UNDER_100.format('(b % 100)')}) end as said from k where b >= 100""")
def spoken_dockets(spark: SparkSession, d: str) -> DataFrame:
    """Dockets as the court reads them: in pairs."""
    cases = read_table(spark, d, "argued_cases").where(F.col("docket").rlike("^[0-9]{1,2}-[1-9][0-9]{2,3}$")).select("docket").distinct()
    return cases.select("docket", spoken.normalise_court(F.col("docket")).alias("said"))


@query(f"""with n as (select p_partkey, 100 + p_size as n from part), r as (select p_partkey, n, 'ONE HUNDRED' || case when n = 100 then '' else ' ' || ({_UNDER_100.format('(n - 100)')}) end as usual,
         'ONE ' || case when n = 100 then 'HUNDRED' when n < 110 then 'OH ' || {_SMALL}[n - 99] else ({_UNDER_100.format('(n - 100)')}) end as pairs, 'ONE ' || {_SMALL}[(n - 100) // 10 + 1] || ' ' || {_SMALL}[n % 10 + 1] as digits from n)
    select p_partkey, [string_split(usual, ' '), string_split(pairs, ' '), string_split(digits, ' ')] as readings from r""")
def number_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """All readings of numbers of three digits."""
    return read_table(spark, d, "part").select("p_partkey", spoken.token_readings((F.col("p_size") + 100).cast("string"), F.lit(None).cast("string")).alias("readings"))


@query(r"""with w as (select meta_row, title, regexp_extract_all(title, '([A-Za-z][A-Za-z''\-]*|\d+(?:st|nd|rd|th)?s?)', 1) as w from media_metadata where title <> ''),
         k as (select *, list_transform(w, lambda x: case when lower(x) in ('bridge', 'lamp', 'portrait', 'vase', 'engraving', 'curved') then 1.0 when lower(x) in ('is', 'are', 'has', 'have', 'sits', 'stands', 'hangs', 'rests', 'covers', 'surrounds', 'unify', 'unifies') then 0.5
                when regexp_full_match(lower(x), '(?:1[0-9]{3}|20[0-2][0-9])s?') then -1.5 when lower(x) in ('war', 'died', 'historic') then -1.0 when lower(x) in ('he', 'she', 'they', 'who', 'him', 'whom') then -1.0 when lower(x) in ('his', 'her', 'their', 'them', 'whose') then -0.5
                when ends_with(lower(x), 'ed') and length(x) > 4 then -0.5 end) as k from w)
    select meta_row, round((coalesce(list_sum(k), 0) - 0.5 * least(3, len(list_filter(w, lambda x, i: i > 1 and regexp_matches(x, '^[A-Z]') and k[i] is null))) - len(regexp_extract_all(title, '(?i)\b\d+(?:st|nd|rd|th)[- ]century\b')))::double, 6) as weight, len(w)::int as words from k""")
def visual_weights(spark: SparkSession, d: str) -> DataFrame:
    """Visual less historic weight of titles."""
    rules = visual.VisualText(["bridge", "lamp", "portrait", "vase", "engraving", "curved"], ["war", "died", "historic"])
    m = read_table(spark, d, "media_metadata").where("title <> ''").select("meta_row", rules.weighed(F.col("title")).alias("v"))
    return m.select("meta_row", F.round("v.weight", 6).alias("weight"), F.col("v.words").alias("words"))


@query("""select 'image' as kind, meta_row as row, (width // 16) * (height // 16) + 2 + 1 as length from media_metadata where width is not null and height is not null union all select 'voice', vec_id, cast(ceil(len(embedding) / 3) as bigint) + 2 + 1 from embeddings""")
def media_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of rows with images and with voice units."""
    m = read_table(spark, d, "media_metadata").where("width is not null and height is not null").select(F.lit("image").alias("kind"), F.col("meta_row").alias("row"), S.estimated_length("image", height=F.col("height"), width=F.col("width"), patch=16).alias("length"))
    v = read_table(spark, d, "embeddings").select(F.lit("voice").alias("kind"), F.col("vec_id").alias("row"), S.estimated_length("voice", units=F.col("embedding"), stretch=3).alias("length"))
    return m.union(v)


@query("select doc_id, length(text) as n from documents where text is not null")
def device_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches through a function that is told its device."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return media.device_batches(docs, lambda device, b: b.assign(n=b["text"].str.len())[["doc_id", "n"]], "doc_id long, n long")


@query(r"""with t as (select distinct unnest(regexp_split_to_array(text, '[ \t\r\n]+')) as token from documents), c as (select token, regexp_replace(token, '["'')]+$', '') as core from t),
         b as (select *, upper(regexp_replace(regexp_replace(core, '^[("'']+', ''), '\.+$', '')) as base from c)
    select token, regexp_matches(core, '[.?!]$') and not (ends_with(core, '.') and (base in ('MR', 'MRS', 'MS', 'DR', 'ST', 'LT', 'JR', 'GEN', 'V', 'VS') or regexp_full_match(base, '\p{L}'))) as ends from b""")
def sentence_end_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Which tokens end a sentence."""
    tokens = read_table(spark, d, "documents").select(F.explode(F.split("text", "[ \t\r\n]+")).alias("token")).distinct()
    return tokens.select("token", X.ends_sentence(F.col("token")).alias("ends"))


@query("select vec_id, list_transform(embedding, lambda x: x::double * 10) as db, round(list_avg(list_transform(embedding, lambda x: power(x::double - list_avg(list_transform(embedding, lambda y: y::double)), 4))) / power(list_avg(list_transform(embedding, lambda x: power(x::double - list_avg(list_transform(embedding, lambda y: y::double)), 2))), 2), 6) as sharpness from embeddings")
def media_measures(spark: SparkSession, d: str) -> DataFrame:
    """Log values in decibels, and the sharpness of a residual."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", media.mel_to_db(F.col("e")).alias("db"), F.round(media.pulse_sharpness(F.col("e")), 6).alias("sharpness"))


@query("""with k as (select o_orderkey, cast(o_orderkey % 4 as int) as n from orders)
    select o_orderkey, list_concat([1, 90], list_transform(generate_series(1, n), lambda i: 91), [92, 2, 95, 96, 96, 97, 99]) as input_ids, list_concat([0, 0], list_transform(generate_series(1, n), lambda i: 1), [1, 0, 0, 2, 2, 2, 0]) as modality_ids,
           list_concat([false, true], list_transform(generate_series(1, n), lambda i: true), [true, false, false, false, false, false, true]) as loss_mask, 9 + n as n_positions from k""")
def placeholder_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts with placeholders of two kinds of media, stretched to their slots."""
    kinds = {"voice": multimodal.Medium(70, 90, 91, 92, 1), "image": multimodal.Medium(80, 95, 96, 97, 2)}
    o = read_table(spark, d, "orders").select("o_orderkey", F.array(F.lit(1), F.lit(70), F.lit(2), F.lit(80)).alias("ids"), F.array((F.col("o_orderkey") % 4).cast("int")).alias("voice"), F.array(F.lit(2)).alias("image"))
    return multimodal.expand_placeholders(o, "ids", kinds, 99, made=["voice"]).select("o_orderkey", "input_ids", "modality_ids", "loss_mask", "n_positions")


@query("select doc_id, lang, unnest(string_split(text, ' ')) as word from documents where text is not null")
def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by several, whole batches at a time; only copied columns stay beside them."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text")

    def split(batch: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        words = batch["text"].str.split(" ")
        rows = [i for i, w in enumerate(words) for _ in w]
        return pd.DataFrame({"word": [x for w in words for x in w]}, dtype=object), rows

    return Sp.replace_rows(docs, split, "word string", ["doc_id", "lang"]).select("doc_id", "lang", "word")


@query("""select 'p' || n_regionkey || '_' || n_nationkey as id, 'p' || n_regionkey as speaker_id, n_name as text, m.microphone from nation, (select unnest(['mic1', 'mic2']) as microphone) m where m.microphone = 'mic2' or n_nationkey % 2 = 0""")
def recordings_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of texts and recordings: a row for each recording that exists."""
    at = _folder(spark)
    for r in J.bounded_rows(read_table(spark, d, "nation"), 100, "nation"):
        speaker, name = f"p{r['n_regionkey']}", f"p{r['n_regionkey']}_{r['n_nationkey']}"
        sinks.write_bytes(spark, f" {r['n_name']}\n".encode(), f"{at}/txt/{speaker}/{name}.txt")
        for mic in ("mic1", "mic2") if r["n_nationkey"] % 2 == 0 else ("mic2",):
            sinks.write_bytes(spark, b"x", f"{at}/wav/{speaker}/{name}_{mic}.flac")
    return files.directory_manifest(spark, at).drop("path")
