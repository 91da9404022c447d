import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import config
from millrace.plans.pipeline import Pipeline, build
from millrace.sources import files, paged, sinks
from millrace.streaming import streams


def test_overlays():
    base = {"pipeline": {"a": {"x": 1, "l": [1, 2]}, "b": {}, "c": {}}}
    over = {"pipeline": {"a": {"l": [3], "x": None}, "b": {"$delete": True}, "n": {"y": 2, "$before": "c"}}}
    got = config.load([base, over], ["pipeline.n.y=5"])
    assert got == {"pipeline": {"a": {"x": None, "l": [3]}, "n": {"y": 5}, "c": {}}} and list(got["pipeline"]) == ["a", "n", "c"]
    assert list(config.load([base, {"pipeline": {"c": {"$after": "a"}}}])["pipeline"]) == ["a", "c", "b"]
    with pytest.raises(ValueError):
        config.load([base, {"pipeline": {"n": {"$before": "zzz"}}}])
    with pytest.raises(ValueError):
        config.load([base, {"pipeline": {"n": {"$oops": 1}}}])
    with pytest.raises(ValueError):
        config.assignment("novalue")
    with pytest.raises(ValueError):
        config.load([base, {"pipeline": {"a": {"$before": "b", "$after": "c"}}}])
    with pytest.raises(ValueError):
        config.load([base, {"pipeline": {"a": {"$before": "a"}}}])
    assert config.load([{"a": 1}, {"a": {"b": {}}}, {"l": [{"$delete": True, "x": 1}]}], ["n.m={k: 2}", "n.z="]) == {"a": {"b": {}}, "l": [{"x": 1}], "n": {"m": {"k": 2}, "z": None}}
    assert list(config.load([base, {"pipeline": {"b": {"$delete": True}}}, {"pipeline": {"b": {"y": 1, "$before": "a"}}}])["pipeline"]) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        config.steps({"a": {"name": "b"}})
    with pytest.raises(TypeError):
        config.steps({"a": 3})
    assert config.steps({"a": None, "b": {"x": 1}}) == [{"name": "a"}, {"name": "b", "x": 1}] and config.steps(None) == []


def test_unknown_steps_and_arguments_fail_early():
    with pytest.raises(ValueError, match="unknown type"):
        build({"name": "x", "type": "nope"})
    with pytest.raises(ValueError):
        build({"name": "x", "type": "range", "colums": ["a"]})


def test_pipeline_end_to_end(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(8)], "id int, text string, k int").write.parquet(f"{tmp_path}/in")
    layers = {"source": {"files": f"{tmp_path}/in"}, "pipeline": {"keep": {"type": "range", "columns": ["id"], "high": 6}, "rename": {"type": "column_renaming", "names": {"text": "body", "k": None}}}, "output": {"path": f"{tmp_path}/out", "fractions": {"train": 0.5, "test": 0.5}, "order_by": ["id"]}, "ancestry": {"datasets": ["origin"]}}
    p = Pipeline(layers)
    p.run(spark)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["id"], r["split"]) for r in out.collect()} == {(i, "train" if i < 3 else "test") for i in range(6)}
    record = json.loads((tmp_path / "out" / "_provenance.json").read_text())
    assert record["ancestry"]["datasets"] == ["origin"] and record["rows_by_step"] == {"keep": 6, "rename": 6}
    with pytest.raises(Exception):
        p.run(spark)
    p.run(spark, clean=True)


def test_scans(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    spark.range(2).write.parquet(f"{tmp_path}/b")
    both = files.scan(spark, "parquet", {"train": f"{tmp_path}/a", "test": f"{tmp_path}/b"}, "train+test")
    assert sorted((r["split"], r["count"]) for r in both.groupBy("split").count().collect()) == [("test", 2), ("train", 3)]
    assert files.scan_splits(spark, str(tmp_path), "a+b").count() == 5
    with pytest.raises(ValueError):
        files.scan(spark, "parquet", {"train": f"{tmp_path}/a"}, "nope")
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"q\n')
    assert files.scan_text_table(spark, f"{tmp_path}/t.tsv").collect()[0] == ("1", '"q')
    (tmp_path / "d.json").write_text('[\n{"id": 1, "l": "PD"},\n{"id": 2, "l": "no"}\n]\n')
    assert [r["id"] for r in files.json_lines(spark, f"{tmp_path}/d.json", "id int, l string", ['"PD"']).collect()] == [1]
    assert files.parse_ranges("2010-2012,7") == [2010, 2011, 2012, 7]
    split = files.split_by_column(spark.createDataFrame([("dev",), ("x",), (None,)], "s string"), "s", {"dev": "validation"}, "split")
    assert sorted(r["split"] for r in split.collect()) == ["validation", "x"]


def test_tar_members(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as t:
        for name in ("j/a.json", "j/b.txt", "k/c.json"):
            data = name.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert [r["value"] for r in files.tar_members(spark, f"{tmp_path}/x.tar.bz2", "j/").collect()] == ["j/a.json"]


def test_tar_batches_are_bounded(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "many.tar.gz", "w:gz") as t:
        for i in range(50):
            info = tarfile.TarInfo(f"{i:03d}.json")
            info.size = 100
            t.addfile(info, io.BytesIO(b"x" * 100))
    got = files.tar_members(spark, f"{tmp_path}/many.tar.gz", batch_bytes=300)
    assert got.count() == 50 and got.select("member").distinct().count() == 50


def test_media_by_path(spark, tmp_path):
    (tmp_path / "m" / "a").mkdir(parents=True)
    (tmp_path / "m" / "a" / "1.wav").write_bytes(b"one")
    (tmp_path / "m" / "1.wav").write_bytes(b"other")
    media = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/m")
    df = spark.createDataFrame([(1, "a/1.wav"), (2, "./a//1.wav"), (3, f"file://{tmp_path}/m/1.wav"), (4, "none.wav"), (5, None)], "k int, path string")
    out = files.with_media(df, media, "path", root=f"{tmp_path}/m")
    assert {r["k"]: r["audio"]["bytes"] and bytes(r["audio"]["bytes"]) for r in out.collect()} == {1: b"one", 2: b"one", 3: b"other", 4: None, 5: None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" not in plan


def test_index_and_source(spark, tmp_path):
    spark.createDataFrame([(0, "a", 1.0)], "row long, id string, x double").write.parquet(f"{tmp_path}/i/train")
    spark.createDataFrame([(0, "a", "t", b"b")], "row long, id string, text string, audio binary").write.parquet(f"{tmp_path}/s")
    index, source = files.load_indexed(spark, f"{tmp_path}/i", "train", f"{tmp_path}/s", ["text"])
    assert source.columns == ["row", "id", "text"] and index.count() == 1
    assert files.load_indexed(spark, f"{tmp_path}/i", "train", f"{tmp_path}/s", ["x", "id"])[1] is None and files.load_indexed(spark, f"{tmp_path}/i", "train")[1] is None


def test_manifest_over_two_levels(spark):
    pages = spark.createDataFrame([("https://h/t/2020.html", '<a href="c/1">A &amp; B</a><a href="/x/2">C</a><a href="c/9">D</a>')], "url string, html string")
    details = spark.createDataFrame([("https://h/t/c/1", "<b>Docket</b><i>1-2</i><b>Date</b><i>x</i>"), ("https://h/x/2", "<b>Judge</b><i>J</i><b>Docket</b><i>7</i>"), ("https://h/z", None)], "url string, html string")
    got = files.linked_manifest(pages, "url", "html", r'<a href="([^"]+)">([^<]+)</a>', 1, ["href", "name"], details, r"<b>([^<]+)</b><i>([^<]+)</i>")
    assert got.columns == ["link", "page", "pos", "href", "name", "Docket", "Date", "Judge"]
    assert sorted(tuple(r)[4:] for r in got.collect()) == [("A & B", "1-2", "x", None), ("C", "7", None, "J"), ("D", None, None, None)]


def test_downloads(tmp_path):
    import io
    import tarfile
    import zipfile

    from millrace.sources import downloads

    content, calls = b"0123456789" * 10, []

    def opener(url, offset):
        calls.append((url, offset))
        if url == "down":
            raise OSError("https://secret")
        if url == "cut" and offset == 0:
            return io.BytesIO(content[:30]), True, len(content)
        return io.BytesIO(content[offset:]), True, len(content)

    assert downloads.download("cut", tmp_path / "a", pause=0, opener=opener).read_bytes() == content and calls == [("cut", 0), ("cut", 30)]
    assert downloads.download("down", tmp_path / "a", opener=opener).read_bytes() == content and len(calls) == 2
    assert downloads.download(["down", "ok"], tmp_path / "b", attempts=2, pause=0, opener=opener).exists()
    with pytest.raises(RuntimeError) as e:
        downloads.download("down", tmp_path / "c", attempts=1, pause=0, opener=opener)
    assert "secret" not in str(e.value)
    with pytest.raises(RuntimeError):
        downloads.download("ok", tmp_path / "d", attempts=1, pause=0, contains=b"absent", opener=opener)
    assert [p.name for p in downloads.download_all({"x": "ok", "y": "ok"}, tmp_path / "f", opener=opener)] == ["x", "y"]
    assert downloads.spellings("22-orig", ["h/{}"]) == ["h/22-orig", "h/22-ORIG", "h/22Orig"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("k/m.txt", "hi")
    assert (downloads.extract(tmp_path / "z.zip", tmp_path / "out") / "k" / "m.txt").read_text() == "hi"
    (tmp_path / "out" / "k" / "m.txt").unlink()
    assert not (downloads.extract(tmp_path / "z.zip", tmp_path / "out") / "k" / "m.txt").exists()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        downloads.extract(tmp_path / "bad.zip", tmp_path / "out2")
    with tarfile.open(tmp_path / "t.tar.xz", "w:xz") as t:
        info = tarfile.TarInfo("n.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    assert (downloads.extract(tmp_path / "t.tar.xz", tmp_path / "out3") / "n.txt").read_text() == "ok"
    import gzip

    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"gz"))
    assert (downloads.extract(tmp_path / "g.txt.gz", tmp_path / "out4") / "g.txt").read_bytes() == b"gz"
    with pytest.raises(ValueError):
        downloads.extract(tmp_path / "a", tmp_path / "out5")
    assert downloads.open_url((tmp_path / "a").as_uri(), 0)[0].read() == content


def test_units_are_resumed_and_splits_cached(spark, tmp_path):
    made = []

    def read(unit):
        made.append(unit)
        if unit == "u3" and made.count("u3") == 1:
            raise OSError("stop")
        return spark.range(2).withColumn("u", F.lit(unit))

    with pytest.raises(OSError):
        sinks.ingest_units(spark, ["u1", "u2", "u3"], read, f"{tmp_path}/units")
    assert sinks.ingest_units(spark, ["u1", "u2", "u3", "u3"], read, f"{tmp_path}/units") == ["u3"] and made == ["u1", "u2", "u3", "u3"]
    assert spark.read.parquet(f"{tmp_path}/units").count() == 6
    with pytest.raises(ValueError):
        sinks.write_unit(spark.range(1), f"{tmp_path}/units", "u1")
    with pytest.raises(ValueError):
        sinks.write_unit(spark.range(1), f"{tmp_path}/units", "a/b")
    built = []
    build = {"train": lambda: built.append("train") or spark.range(3), "test": lambda: built.append("test") or spark.range(1)}
    assert sinks.cached(spark, f"{tmp_path}/cache", build).groupBy("split").count().count() == 2
    (tmp_path / "cache" / "split=test" / "_SUCCESS").unlink()
    assert sinks.cached(spark, f"{tmp_path}/cache", build).count() == 4 and built == ["train", "test", "test"]


def test_shards_by_bytes_and_added_splits(spark, tmp_path):
    df = spark.range(3000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 40).alias("t"), F.when(F.col("id") < 2500, "train").otherwise("test").alias("split"))
    assert sinks.shard_plan(df, target_mb=1) == {"train": 3, "test": 1}
    for order in ((), ("id",)):
        out = f"{tmp_path}/o{len(order)}"
        sinks.write_splits(df, out, target_mb=1, order_by=order)
        assert spark.read.parquet(out).count() == 3000
        assert 2 <= len(list((tmp_path / f"o{len(order)}" / "split=train").glob("*.parquet"))) <= 4
    with pytest.raises(ValueError, match="written twice"):
        sinks.write_splits(df, f"{tmp_path}/o0", add=True)
    sinks.write_splits(df.withColumn("split", F.lit("validation")), f"{tmp_path}/o0", add=True)
    assert spark.read.parquet(f"{tmp_path}/o0").count() == 6000
    record = sinks.provenance_record({})
    assert record["cli"] and (record["git_commit"] is None or len(record["git_commit"]) == 40)


def test_manifest(spark):
    pages = spark.createDataFrame([('<a href="/c/1">A &amp; B</a> 10/05/21 <a href="/c/2">C</a> 01/02/99',), (None,)], "html string")
    got = files.manifest_rows(pages, "html", r'<a href="([^"]+)">([^<]+)</a> (\d\d/\d\d/\d\d)', ["url", "name", "day"], "day")
    assert [(r["url"], r["name"], str(r["day"])) for r in got.collect()] == [("/c/1", "A & B", "2021-10-05"), ("/c/2", "C", "2099-01-02")]


def test_directory_manifest(spark, tmp_path):
    for p, text in (("txt/p1/p1_001.txt", " a  b\n"), ("txt/p1/p1_002.txt", "c"), ("wav/p1/p1_001_mic1.flac", "x"), ("wav/p1/p1_001_mic2.flac", "x"), ("wav/p1/p1_002_mic2.flac", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    got = sorted((r["id"], r["speaker_id"], r["text"], r["microphone"]) for r in files.directory_manifest(spark, str(tmp_path)).collect())
    assert got == [("p1_001", "p1", "a b", "mic1"), ("p1_001", "p1", "a b", "mic2"), ("p1_002", "p1", "c", "mic2")]


def test_paged(spark):
    def request(unit, cursor):
        table = {"east": [(["a", "b"], "1"), (["c"], "2"), (["d"], None)], "west": [(["e"], None)]}
        return table[unit][int(cursor or 0)]

    assert list(paged.pages(request, "east")) == list("abcd") and list(paged.pages(request, "east", max_pages=2)) == list("abc")
    got = paged.read_paged(spark, "fake_pages", ["east", "west"], request).collect()
    assert sorted(r["value"] for r in got) == [f'"{c}"' for c in "abcde"]

    def bad(unit, cursor):
        raise ValueError("https://secret")

    with pytest.raises(RuntimeError) as e:
        list(paged.pages(bad, "u", retries=1, backoff=0))
    assert "secret" not in str(e.value)
    assert paged.bounded_units((0, 7), lambda w: w[1] - w[0] + 1, lambda w: paged.halves(*w), 3) == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_sinks(spark, tmp_path):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "key string, id long")
    sinks.write_id_map(ids, f"{tmp_path}/ids")
    assert sinks.read_id_map(spark, f"{tmp_path}/ids").count() == 2
    with pytest.raises(Exception, match="tab or line break"):
        sinks.write_frequencies(spark.createDataFrame([("a\tb", 1)], "text string, n long"), f"{tmp_path}/f")
    written: set = set()
    sinks.check_collisions(written, ["train"])
    with pytest.raises(ValueError):
        sinks.check_collisions(written, ["train"])
    assert sinks.shard_count(10, 0) == 1 and sinks.shard_count(3, 10**12) == 3
    spark.range(3).withColumn("unit", F.lit("u1")).write.partitionBy("unit").parquet(f"{tmp_path}/units")
    assert sinks.read_written_units(spark, f"{tmp_path}/units") == {"u1"} and sinks.read_written_units(spark, f"{tmp_path}/none") == set()


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2031-01-01 00:00:00"), (1, "2031-01-01 00:00:10"), (2, "2031-01-01 05:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, ts timestamp").parquet(f"{tmp_path}/in")
    for name, df, mode in (("dedup", streams.deduplicated(stream, "k", "ts", "1 hour"), "append"), ("sess", streams.sessions(stream, "ts", "1 hour", "5 minutes", "k"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("dedup").count() == 2 and sorted(r["n"] for r in spark.table("sess").collect()) == [1, 2]
