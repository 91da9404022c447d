"""Scans: files by format and split, index and source pairs, text dumps, tar members, media files, manifests."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import check_same_features, col
from millrace.operators.sets import concatenate


def scan(spark: SparkSession, fmt: str, files: Mapping[str, str | Sequence[str]] | str | Sequence[str], split: str | None = None, schema: T.StructType | str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Files of a format with a column `split`: a mapping split -> files, or bare files for one split (`train` unless named). A split `a+b` reads both."""
    named = files if isinstance(files, Mapping) else {split or "train": files}
    wanted = split.split("+") if split and isinstance(files, Mapping) else list(named)
    frames = {}
    for name in wanted:
        if name not in named:
            raise ValueError(f"no files for split {name!r}")
        reader = spark.read.format(fmt).options(**(options or {}))
        reader = reader.schema(schema) if schema is not None else reader
        paths = [named[name]] if isinstance(named[name], str) else list(named[name])
        frames[name] = reader.load(paths)
    check_same_features(frames)
    return concatenate([f.withColumn("split", F.lit(name)) for name, f in frames.items()])


def scan_splits(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Parquet under root/<name> for each name of `a+b`; a name without files is an error."""
    return concatenate([spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in split.split("+")])


def load_indexed(spark: SparkSession, index_path: str, split: str, source_path: str | None = None, wanted: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(index, source) for `join_index`. The source is None without a path, and where the index has all wanted columns; else it is read with the wanted columns, row and id alone."""
    index = scan_splits(spark, index_path, split)
    if source_path is None or (wanted is not None and set(wanted) <= set(index.columns)):
        return index, None
    source = spark.read.parquet(source_path)
    keep = source.columns if wanted is None else [c for c in source.columns if c in {*wanted, "row", "id"}]
    return index, source.select(*[col(c) for c in keep])


def scan_text_table(spark: SparkSession, path: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """A table with a header, all columns text, no quoting, no inference."""
    return spark.read.csv(path if isinstance(path, str) else list(path), sep=sep, header=True, quote="", escape="", inferSchema=False)


def split_by_column(df: DataFrame, column: str, names: Mapping[str, str] | None = None, out: str = "split") -> DataFrame:
    """One split per value of a column, renamed by a mapping where it has the value; nulls are no split and go."""
    value = col(column).cast("string")
    renamed = value
    for old, new in (names or {}).items():
        renamed = F.when(value == old, F.lit(new)).otherwise(renamed)
    return df.where(value.isNotNull()).withColumn(out, renamed)


def json_lines(spark: SparkSession, path: str, schema: str, contains: Sequence[str] = ()) -> DataFrame:
    """JSON lines by an explicit schema; lines without any of the marks are dropped before they are parsed. Lines that can't be read give no row."""
    lines = spark.read.text(path)
    if contains:
        some = F.lit(False)
        for mark in contains:
            some = some | F.contains("value", F.lit(mark))
        lines = lines.where(some)
    text = F.regexp_replace(F.trim("value"), ",+$", "")
    return lines.where(F.startswith(text, F.lit("{"))).select(F.from_json(text, schema).alias("r")).select("r.*")


def files_under(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files under a folder or matching a pattern; a listing, no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length")


def tar_members(spark: SparkSession, path: str, prefix: str = "", suffix: str = ".json", batch_bytes: int = 32 << 20) -> DataFrame:
    """(archive, member, value): text of the members of tar archives, compressed or not.

    An archive is one task, which reads it as a stream: no archive is ever held as a whole, members come in batches of about
    `batch_bytes`. Paths are opened by pyarrow's file systems (local, HDFS, object stores).
    """
    archives = files_under(spark, path).select("path")
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("value", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b.column("path").to_pylist()):
            system, inner = pa.fs.FileSystem.from_uri(name)
            members, values, held = [], [], 0
            with system.open_input_stream(inner, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
                for member in archive:
                    if member.isfile() and member.name.startswith(prefix) and member.name.endswith(suffix):
                        members.append(member.name)
                        values.append(archive.extractfile(member).read().decode("utf-8", "replace"))
                        held += member.size
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(members)), pa.array(members), pa.array(values)], schema=schema)
                        members, values, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(members), pa.string()), pa.array(members, pa.string()), pa.array(values, pa.string())], schema=schema)

    parts = max(1, archives.count())
    return archives.repartition(parts, "path").mapInArrow(read, "archive string, member string, value string")


def media_key(path: Column, root: str = "") -> Column:
    """A path as media are joined by: below `root`, without scheme, doubled slashes and `./`."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?=/)", ""), "/(?:\\./)+|/{2,}", "/")
    top = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(?=/)", "", root)
    top = re.sub("/{2,}", "/", top).rstrip("/")
    below = F.when(bare.startswith(top + "/"), F.substring(bare, len(top) + 2, 1 << 30)).otherwise(bare) if top else bare
    return F.regexp_replace(below, r"^(?:\./)+|^/+", "")


def with_media(df: DataFrame, media: DataFrame, path_column: str, out: str = "audio", root: str = "") -> DataFrame:
    """Embeds media bytes: `media` (path, content) is a binaryFile scan, paths of `df` are full or below `root`. A row without its file has null bytes, a null path too.

    An equi join on the path below the root; both sides are shuffled, as bytes are too large to be broadcast, and rows that
    share a file each get it.
    """
    m = media.select(media_key(F.col("path"), root).alias("__p"), F.col("content").alias("__c")).hint("merge")
    joined = df.withColumn("__k", media_key(col(path_column), root)).join(m, F.col("__k") == F.col("__p"), "left")
    return joined.withColumn(out, F.struct(F.col("__c").alias("bytes"), col(path_column).alias("path"))).drop("__p", "__c", "__k")


def with_durations(df: DataFrame, durations: DataFrame, key: str, name: str, millis: str, fallback: Column, out: str = "duration_s") -> DataFrame:
    """Durations from a side file in milliseconds, else by a fallback."""
    from millrace.operators.joins import join_with_fallback

    side = durations.select(col(name).alias("__n"), (col(millis).cast("double") / 1000).alias(out))
    return join_with_fallback(df.drop(out).withColumn("__n", col(key)), side, "__n", out, fallback).drop("__n")


def directory_manifest(spark: SparkSession, root: str, microphones: Sequence[str] = ("mic1", "mic2")) -> DataFrame:
    """(id, speaker_id, text, microphone, path): texts under txt/<speaker>/<id>.txt with the recordings that exist under wav/<speaker>/<id>_<mic>.*; white space in texts collapsed."""
    from millrace.functions.text import collapse

    texts = spark.read.text(f"{root}/txt/*/*.txt", wholetext=True).select("value", F.input_file_name().alias("p"))
    texts = texts.select(collapse(F.col("value")).alias("text"), F.regexp_extract("p", r"/txt/([^/]+)/[^/]+$", 1).alias("speaker_id"), F.regexp_extract("p", r"/([^/]+)\.txt$", 1).alias("id"))
    wide = texts.select("*", F.explode(F.array(*[F.lit(m) for m in microphones])).alias("microphone"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/wav").select("path")
    found = files.select("path", F.regexp_extract("path", r"/([^/]+)_([^/_]+)\.[^./]+$", 1).alias("id"), F.regexp_extract("path", r"/([^/]+)_([^/_]+)\.[^./]+$", 2).alias("microphone"))
    return wide.join(found, ["id", "microphone"]).select("id", "speaker_id", "text", "microphone", "path")


def manifest_rows(pages: DataFrame, html: str, pattern: str, fields: Sequence[str], date: str | None = None) -> DataFrame:
    """Rows from pages of HTML: every match of a pattern, its groups as fields in order, entities unescaped; a date field `MM/dd/yy` becomes a date."""
    from millrace.functions.text import clean_text

    hits = pages.select(F.explode(F.regexp_extract_all(col(html), F.lit(pattern), 0)).alias("__m"))
    out = hits.select(*[clean_text(F.regexp_extract("__m", pattern, i + 1)).alias(f) for i, f in enumerate(fields)])
    return out.withColumn(date, F.to_date(date, "MM/dd/yy")) if date else out


def linked_manifest(pages: DataFrame, url: str, html: str, item: str, link: int, fields: Sequence[str], details: DataFrame, detail: str) -> DataFrame:
    """Manifests over two levels: items of list pages by a pattern (its groups are `fields`, group `link` is an address relative to the page), each with the name-value pairs that a second pattern finds on the page it links to.

    The pairs' names become columns in the order in which they are first seen (by page address, then place); at most 1,000 names. Items
    without a page have nulls. `details` has the columns url and html.
    """
    from millrace.functions.text import clean_text
    from millrace.session import bounded_rows

    hits = pages.select(col(url).alias("page"), F.posexplode(F.regexp_extract_all(col(html), F.lit(item), 0)).alias("pos", "__m"))
    items = hits.select("page", "pos", *[clean_text(F.regexp_extract("__m", item, i + 1)).alias(f) for i, f in enumerate(fields)], F.regexp_extract("__m", item, link).alias("__l"))
    absolute = F.when(F.col("__l").rlike("^[a-zA-Z]+://"), F.col("__l")).when(F.col("__l").startswith("/"), F.concat(F.regexp_extract("page", "^[a-zA-Z]+://[^/]+", 0), "__l")).otherwise(F.concat(F.regexp_replace("page", "[^/]*$", ""), "__l"))
    pairs = details.select(F.col("url").alias("link"), F.posexplode(F.regexp_extract_all("html", F.lit(detail), 0)).alias("__pos", "__m"))
    pairs = pairs.select("link", "__pos", clean_text(F.regexp_extract("__m", detail, 1)).alias("name"), clean_text(F.regexp_extract("__m", detail, 2)).alias("value")).where("name is not null")
    names = bounded_rows(pairs.groupBy("name").agg(F.min(F.struct("link", "__pos")).alias("first")).orderBy("first", "name").select("name"), 1000, "the list of names")
    wide = pairs.groupBy("link").agg(*[F.min_by(F.when(F.col("name") == r["name"], F.col("value")), F.when(F.col("name") == r["name"], F.col("__pos"))).alias(r["name"]) for r in names]) if names else pairs.select("link").distinct()
    return items.withColumn("link", absolute).drop("__l").join(wide, "link", "left")


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of Parquet files: those of a folder, or one file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def parse_ranges(text: str) -> list[int]:
    """`2010-2013`, `1,3,5` or `7` as numbers."""
    out: list[int] = []
    for part in text.split(","):
        lo, _, hi = part.strip().partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    return out
