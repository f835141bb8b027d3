import os
import random

import pytest
from pyspark.sql import functions as F

from parcelyard.operators import catalog, chunks, layout, ordered
from parcelyard.plans import packages
from parcelyard.sources import archive_format, files
from parcelyard.streaming.asset_stream import AssetStream, Resources


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    rng = random.Random(5)
    made = {"a/empty.json": b"", "a/one.json": b"x", "b/big.json": rng.randbytes(300_000), "b/copy.json": b"same" * 500, "c/copy2.json": b"same" * 500, "t/raw.dds": rng.randbytes(10_000), "u/text.txt": b"hello world " * 30_000}
    for p, c in made.items():
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_bytes(c)
    return str(root), made


@pytest.mark.parametrize("passphrase", [None, "secret words"])
def test_pack_read_verify_unpack(spark, tree, tmp_path, passphrase):
    root, made = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"), passphrase=passphrase)
    p = packages.Package(spark, str(tmp_path / "p"), passphrase)
    assert {r["path"]: bytes(r["content"] or b"") for r in p.contents().collect()} == made
    assert p.all_ok()
    rows = {r["path"]: r for r in p.entries().collect()}
    assert rows["b/copy.json"]["offset"] == rows["c/copy2.json"]["offset"]
    assert rows["t/raw.dds"]["offset"] % 4096 == 0 and rows["t/raw.dds"]["method"] == "GDeflate"
    assert packages.unpack(p, str(tmp_path / "out")) == len(made)
    for path, content in made.items():
        assert (tmp_path / "out" / path).read_bytes() == content
    if passphrase:
        with pytest.raises(ValueError):
            packages.Package(spark, str(tmp_path / "p")).chunk_table()


def test_archive_files_round_trip(spark, tree, tmp_path):
    root, made = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"))
    p = packages.Package(spark, str(tmp_path / "p"))
    t, d = str(tmp_path / "x.gtoc"), str(tmp_path / "x.gdat")
    archive_format.write_archive(p, t, d)
    archive_format.register(spark)
    toc = spark.read.format("parcel_toc").option("rowsPerPartition", "3").load(t)
    assert toc.rdd.getNumPartitions() == 3
    names = {r["asset_id"]: r["path"] for r in archive_format.read_names(spark, t).collect()}
    assert sorted(names.values()) == sorted(made)
    got = {names[r["asset_id"]]: bytes(r["content"]) for r in archive_format.read_contents(toc, t, d).collect()}
    assert got == made
    raw = bytearray(open(t, "rb").read())
    raw[0] ^= 1
    bad = str(tmp_path / "bad.gtoc")
    open(bad, "wb").write(raw)
    with pytest.raises(Exception, match="not an archive"):
        spark.read.format("parcel_toc").load(bad).collect()


@pytest.mark.parametrize("passphrase", [None, "secret words"])
def test_archive_is_written_by_tasks(spark, tree, tmp_path, monkeypatch, passphrase):
    """no row of a package passes through the driver; empty entries and gaps between payloads come out right."""
    root, made = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"), passphrase=passphrase, chunk=4096)
    p = packages.Package(spark, str(tmp_path / "p"), passphrase)
    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "toPandas"):
            m.setattr(type(spark.range(0)), name, lambda *_: pytest.fail("rows reach the driver"))
        archive_format.write_archive(p, str(tmp_path / "x.gtoc"), str(tmp_path / "x.gdat"))
    archive_format.register(spark)
    toc = spark.read.format("parcel_toc").load(str(tmp_path / "x.gtoc"))
    assert [r["asset_id"] for r in toc.collect()] == sorted(r["asset_id"] for r in p.toc.collect())
    names = {r["asset_id"]: r["path"] for r in archive_format.read_names(spark, str(tmp_path / "x.gtoc")).collect()}
    got = archive_format.read_contents(toc, str(tmp_path / "x.gtoc"), str(tmp_path / "x.gdat"), passphrase).collect()
    assert {names[r["asset_id"]]: bytes(r["content"]) for r in got} == made


def test_names_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """names of any length, over blocks and runs, reach the plan as a scan, not as rows from the driver."""
    import struct
    import uuid

    rng = random.Random(3)
    made = {str(uuid.UUID(int=i)): "ü" * rng.choice([0, 1, 40, 30_000]) + str(i) for i in range(1, 60)}
    names = b"".join(uuid.UUID(i).bytes_le + struct.pack("<H", len(p.encode())) + p.encode() for i, p in made.items())
    t = str(tmp_path / "n.gtoc")
    whole = struct.pack("<iiiiqq", 0x4B435047, 1, len(made), 0, 64, 64).ljust(64, b"\0") + names
    open(t, "wb").write(whole)
    got = archive_format.read_names(spark, t)
    assert {r["asset_id"]: r["path"] for r in got.collect()} == made and got.count() == len(made)
    assert "LocalRelation" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(archive_format, "_BLOCK", 1000)
    for step in (1, 7, 59, 60):
        runs = archive_format.name_ranges(t, step)
        assert [n for *_, n in runs] == [step] * (59 // step) + [59 % step] * (59 % step > 0)
        assert runs[0][0] == 64 and runs[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    open(t, "wb").write(whole[:-40_000])
    with pytest.raises(EOFError):
        archive_format.name_ranges(t, 7)


@pytest.mark.parametrize("method", [0, 2, 3])
def test_workers_hand_on_slices(spark, method):
    """what a Python worker has made leaves it by the megabyte, in the same rows."""
    texts = {str(i): bytes([i % 251]) * (i * 37 % 9000) for i in range(3000)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "path string, content binary").coalesce(1)
    stored = chunks.encode(chunks.split(df, chunk=4096), F.lit(method), 1)
    back = chunks.restore(stored, F.lit(method)).collect()
    assert len(back) == 3000 and all(bytes(r["content"]) == texts[r["path"]] for r in back)
    sizes = stored.select("compressed_size", "original_size", F.octet_length("data").alias("n")).collect()
    assert all(r["compressed_size"] == r["n"] <= r["original_size"] for r in sizes)
    ok = chunks.decodes(stored.withColumn("data", F.when(F.col("path") != "7", F.col("data"))), F.lit(method), ["path"])
    assert {r["path"] for r in ok.filter("not ok").collect()} == {"7"}
    import pyarrow as pa

    seen = []

    class Frame:  # stands for the table: hands its batches to what mapInArrow is given
        columns, schema = ["k", "raw"], spark.createDataFrame([], "k long, raw binary").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            seen.extend(run(iter([pa.RecordBatch.from_pydict({"k": list(range(64)), "raw": [b"x" * 100_000] * 64})])))

    from parcelyard.functions import codecs

    codecs.by_row(Frame(), lambda raw: (raw,), ["raw"], {"data": "binary"})
    assert len(seen) > 5 and [k for b in seen for k in b.column(0).to_pylist()] == list(range(64))


def test_contents_are_not_shuffled_once_decoded(spark, tree, tmp_path):
    """Decoded contents leave their task as they are; only stored chunks and small columns are dealt out."""
    root, made = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"), "Zstd", passphrase="secret words")
    found = packages.Package(spark, str(tmp_path / "p"), "secret words").contents()
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    top = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    assert not any("Exchange" in x or "Join" in x for x in lines[:top])
    assert {r["path"]: bytes(r["content"]) for r in found.collect()} == made


def test_pack_writes_one_copy_without_dedup_too(spark, tree, tmp_path):
    """The narrowed layout gives the places, metadata and contents of both ways to pack."""
    root, made = tree
    for dedup in (True, False):
        at = str(tmp_path / f"p{dedup}")
        packages.pack(files.read_files(spark, root), at, dedup=dedup)
        p = packages.Package(spark, at)
        assert {r["path"]: bytes(r["content"]) for r in p.contents().collect()} == made and p.all_ok()
        offsets = {r["path"]: r["offset"] for r in p.entries().collect()}
        assert (offsets["b/copy.json"] == offsets["c/copy2.json"]) == dedup
        stored = spark.read.parquet(f"{at}/blob").select("blob_id").distinct().count()
        assert stored == len(made) - dedup


def test_verify_takes_chunks_by_slices(spark, tree, tmp_path):
    """no worker is given whole columns of chunks; only ids and answers come back."""
    root, made = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"))
    found = packages.Package(spark, str(tmp_path / "p")).verify()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert found.filter("ok").count() == len(made)


def test_damaged_blob_is_found(spark, tree, tmp_path):
    root, _ = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"))
    p = packages.Package(spark, str(tmp_path / "p"))
    blob = spark.read.parquet(f"{p.path}/blob")
    blob.withColumn("data", F.when(F.octet_length("data") > 100, F.substring("data", 1, 90)).otherwise(F.col("data"))).write.parquet(str(tmp_path / "b2"))
    os.rename(f"{p.path}/blob", str(tmp_path / "b1"))
    os.rename(str(tmp_path / "b2"), f"{p.path}/blob")
    assert not p.all_ok()


def test_stream_and_resources(spark, tree, tmp_path):
    root, made = tree
    packages.pack(files.read_files(spark, root), str(tmp_path / "p"))
    p = packages.Package(spark, str(tmp_path / "p"))
    ids = {r["path"]: r["asset_id"] for r in p.names.collect()}
    s = AssetStream(p, ids["b/big.json"])
    big = made["b/big.json"]
    s.seek(131_000)
    assert s.read(200) == big[131_000:131_200]
    assert s.seek(10**9) == len(big) and s.read() == b""
    assert s.seek(-10, 2) == len(big) - 10 and s.read(100) == big[-10:]
    r = Resources([p])
    assert r.load(ids["a/one.json"], str) == "x" and r.load(ids["a/one.json"]) == b"x"
    with pytest.raises(FileNotFoundError):
        r.load("nothing")


def test_refuses_equal_ids_and_unsafe_paths(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", bytearray(b"1")), ("A.TXT", bytearray(b"2"))], "path string, content binary")
    with pytest.raises(ValueError):
        packages.pack(df, str(tmp_path / "p"))
    for bad in ("../x", "/x", "a/../../x", "C:\\x", "a\\..\\b"):
        with pytest.raises(Exception, match="unsafe"):
            spark.createDataFrame([(bad,)], "p string").select(packages.safe_path(F.col("p"))).collect()


def test_layout_against_walk(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(f"{rng.choice('aAbB_')}{i:03d}", rng.choice([0, 1, 15, 16, 17, 5000, 4096]), rng.choice([16, 16, 16, 4096])) for i in range(150)]
        df = spark.createDataFrame(rows, "path string, size long, align int").repartition(7)
        got = {r["path"]: r["data_offset"] for r in layout.aligned_offsets(df).collect()}
        ptr = 0
        for path, size, align in sorted(rows, key=lambda r: (r[0].upper(), r[0])):
            at = (ptr + align - 1) & ~(align - 1)
            assert got[path] == at
            ptr = at + size


def test_running_previous_and_empty(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["s"] for r in ordered.running(df, [F.col("id")], {"s": F.col("v")}).collect()}
    assert all(got[i] == sum(j % 7 for j in range(i)) for i in (0, 1, 499, 999))
    prev = {r["id"]: r["p"] for r in ordered.previous(df, [F.col("id")], F.col("id"), "p").collect()}
    assert prev == {i: (i - 1 if i else None) for i in range(1000)}
    none = df.filter("id < 0")
    assert ordered.running(none, [F.col("id")], {"s": F.col("v")}).collect() == []
    assert layout.aligned_offsets(none.select(F.col("id").cast("string").alias("path"), F.col("v").alias("size"), F.lit(16).alias("align"))).collect() == []


def test_chunks_of_edge_sizes(spark):
    for n in (0, 1, 131_071, 131_072, 131_073):
        df = spark.createDataFrame([("p", bytearray(b"z" * n))], "path string, content binary")
        parts = chunks.split(df)
        assert parts.count() == max(1, -(-n // 131_072))
        back = chunks.assemble(parts).first()["content"]
        assert bytes(back or b"") == b"z" * n


def test_overlay_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "path string, v int")
    b = spark.createDataFrame([("X", 2)], "path string, v int")
    c = spark.createDataFrame([("y", 3), ("z", 3)], "path string, v int")
    view = {r["path"].lower(): r["v"] for r in catalog.overlay(catalog.mounted([a, b, c])).collect()}
    assert view == {"x": 2, "y": 3, "z": 3}
    top = {r["path"].lower(): r["v"] for r in catalog.loose_override(catalog.mounted([a]), catalog.mounted([b, c])).collect()}
    assert top == {"x": 1, "y": 1, "z": 3}


def test_missing_root_and_single_file(spark, tmp_path):
    assert files.file_map(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "f.bin").write_bytes(b"1")
    assert [r["rel_path"] for r in files.file_map(spark, str(tmp_path / "f.bin")).collect()] == ["f.bin"]


def test_synthetic_inputs(spark):
    rows = files.synthetic(spark, 5, 2, 8192).collect()
    assert len(rows) == 7 and sum(len(r["content"]) == 8192 for r in rows) == 2
