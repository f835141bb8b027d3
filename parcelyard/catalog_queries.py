"""Registered catalog queries and their SQL.

Assets are derived from the ``documents`` table: a path, the text as content, its
size in bytes, and an alignment.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import crypto, dds, ids, meta
from .operators import catalog, chunks, layout, ordered
from .plans import packages
from .session import shared_dir, shared_table
from .sources import archive_format

CHUNK = 4096  # small, so that test documents have several chunks

# The same assets for both engines, in each one's words.
_A = """select doc_id, text, concat(source, '/', lang, '/Doc_', cast(doc_id as {str}), case when doc_id % 5 = 0 then '.DDS' else '.json' end) as path,
 cast({bytes}(text) as bigint) as size, case when doc_id % 5 = 0 then 4096 else 16 end as align, case when doc_id % 5 = 0 then 1 else 2 end as method from documents where text is not null"""
DUCK_A = _A.format(str="varchar", bytes="strlen")
#: Stored sizes without a codec, which SQL can compute: three quarters, rounded up, as if compressed.
DUCK_TOC = f"""select doc_id, path, size as original_size, cast(ceil(size * 0.75) as bigint) as compressed_size, align, method,
 cast(256 | 1 | (method << 2) | (case when method = 1 then 32 else 0 end) | (cast(log2(align) as bigint) << 24) as bigint) as flags,
 cast((((doc_id % 4000) + 1) << 16) | ((doc_id % 2000) + 1) as bigint) as meta1, cast((((doc_id % 12) + 1) << 24) | ((size * 3) % 16777216) as bigint) as meta2 from (DUCK_A)""".replace("DUCK_A", DUCK_A)


def assets(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang").filter("text is not null")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/Doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".DDS").otherwise(".json"))
    out = d.withColumn("path", path).withColumn("size", F.octet_length("text").cast("long"))
    out = out.withColumn("method", meta.choose_method(F.col("path"))).withColumn("align", meta.alignment(F.col("method")))
    return out.select("doc_id", "path", "size", "align", "method", *more)


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir, "text").withColumn("content_hash", F.sha2("text", 256)).drop("text")


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    m1 = F.shiftleft((F.col("doc_id") % 4000) + 1, 16).bitwiseOR((F.col("doc_id") % 2000) + 1)
    m2 = F.shiftleft((F.col("doc_id") % 12) + 1, 24).bitwiseOR((F.col("size") * 3) % 16777216)
    return a.select("doc_id", "path", F.col("size").alias("original_size"), F.ceil(F.col("size") * 0.75).cast("long").alias("compressed_size"), "align", "method", meta.encode_flags(F.col("method"), F.col("align"), texture=F.col("method") == 1).alias("flags"), m1.alias("meta1"), m2.alias("meta2"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated assets with offsets, as a table."""
    return shared_table(layout.aligned_offsets(layout.first_of_hash(hashed(spark, sf_dir))))


DUCK_PLACED = f"""a as ({DUCK_A}),
f as (select *, row_number() over (partition by sha256(text) order by upper(path), path) as rn from a),
u as (select path, size, align, cast(ceil(size / 16.0) as bigint) * 16 as p, sum(case when align = 4096 then 1 else 0 end) over (order by upper(path), path rows between unbounded preceding and current row) as seg from f where rn = 1),
w as (select *, coalesce(sum(p) over (partition by seg order by upper(path), path rows between unbounded preceding and 1 preceding), 0) as within_off from u),
g as (select seg, cast(ceil(sum(p) / 4096.0) as bigint) * 4096 as t from u group by seg),
b as (select seg, coalesce(sum(t) over (order by seg rows between unbounded preceding and 1 preceding), 0) as base from g),
placed as (select w.path, w.size, w.align, cast(b.base + w.within_off as bigint) as data_offset from w join b on w.seg = b.seg)"""


def layout_offsets(spark, sf_dir):
    return layout.aligned_offsets(layout.first_of_hash(hashed(spark, sf_dir))).select("path", "data_offset")


def shared_offsets(spark, sf_dir):
    return layout.deduplicated_offsets(hashed(spark, sf_dir)).select("path", "data_offset")


def toc_pointer(spark, sf_dir):
    a = assets(spark, sf_dir)
    head = a.agg((F.lit(S.HEADER_BYTES) + F.count("*") * S.ROW_BYTES + F.sum(18 + F.octet_length("path"))).cast("long").alias("base"))
    return layout.table_pointers(a.withColumn("base", head.scalar()), F.col("base"), 8 * chunks.count(F.col("size"), CHUNK)).select("path", "chunk_table_offset")


def chunk_sizes(spark, sf_dir):
    return chunks.sizes(assets(spark, sf_dir), chunk=CHUNK)


def chunk_offsets(spark, sf_dir):
    return chunks.offsets(chunk_sizes(spark, sf_dir))


def chunk_at_position(spark, sf_dir):
    wanted = assets(spark, sf_dir).select("path", F.floor(F.col("size") * 2 / 3).cast("long").alias("pos"))
    return chunks.at_position(chunk_sizes(spark, sf_dir), wanted)


def batch_rebase(spark, sf_dir):
    return chunks.rebase(chunk_sizes(spark, sf_dir)).select("path", "chunk_idx", F.col("batch_offset").cast("long").alias("batch_offset"))


def nested_sum(spark, sf_dir):
    rows = chunk_sizes(spark, sf_dir).groupBy("path").agg(F.collect_list(F.struct(F.col("chunk_size").alias("original_size"), F.ceil(F.col("chunk_size") * 0.5).cast("long").alias("compressed_size"))).alias("chunks"))
    return chunks.totals(rows).select("path", "sum_compressed", "sum_original")


def encode_flags(spark, sf_dir):
    return toc(spark, sf_dir).select("path", "flags")


def decode_flags(spark, sf_dir):
    f = F.col("flags")
    return toc(spark, sf_dir).select("path", meta.method_name(f).alias("method"), meta.decode_alignment(f).alias("alignment"), meta.is_encrypted(f).alias("encrypted"), meta.is_texture(f).alias("texture"))


def choose_method(spark, sf_dir):
    return assets(spark, sf_dir).select("path", F.col("method").cast("long").alias("method"), F.col("align").cast("long").alias("align"))


def texture_info(spark, sf_dir):
    return toc(spark, sf_dir).filter(meta.is_texture(F.col("flags"))).select("path", meta.texture_info(F.col("meta1"), F.col("meta2")).alias("info"))


def ratio(spark, sf_dir):
    return toc(spark, sf_dir).select("path", meta.ratio(F.col("compressed_size"), F.col("original_size")).alias("ratio"))


def display_info(spark, sf_dir):
    return toc(spark, sf_dir).select("doc_id", meta.show_path(F.col("path"), 15).alias("shown"), F.expr("original_size div 1024").cast("long").alias("kb"))


def size_label(spark, sf_dir):
    n = F.col("original_size")
    return toc(spark, sf_dir).select("path", F.when(n < 1024, "B").otherwise("MB").alias("unit"), F.when(n < 1024, n.cast("double")).otherwise(n / 1048576.0).alias("amount"), F.when(n < 1024, meta.size_label(n)).alias("label"))


def method_label(spark, sf_dir):
    t = toc(spark, sf_dir)
    pct = F.floor(meta.ratio(F.col("compressed_size"), F.col("original_size")))
    return t.select("path", meta.method_label(F.col("doc_id") % 7 == 0, meta.method_name(F.col("flags")), F.col("doc_id") % 3 == 0, pct).alias("label"))


def block_map(spark, sf_dir):
    t = toc(spark, sf_dir)
    total = t.agg(F.sum("compressed_size").alias("total"))
    return t.withColumn("total", total.scalar()).select("path", meta.block_width(F.col("compressed_size"), F.col("total")).alias("width"), meta.block_colour(meta.method_name(F.col("flags"))).alias("colour"))


def list_label(spark, sf_dir):
    icon, text = meta.list_label(F.col("path"), F.sha2("path", 256))
    return assets(spark, sf_dir).select("path", icon.alias("icon"), text.alias("label"))


def search(spark, sf_dir):
    return catalog.search(assets(spark, sf_dir), "DOC_1").select("path")


def suffix(spark, sf_dir):
    a = assets(spark, sf_dir)
    return a.select("path", meta.has_suffix(F.col("path"), ".dds").alias("any_case"), meta.has_suffix(F.col("path"), ".dds", any_case=False).alias("exact_case"))


def gdeflate_only(spark, sf_dir):
    return toc(spark, sf_dir).filter(meta.method_number(F.col("flags")) == S.GDEFLATE).select("path", "flags")


def misaligned(spark, sf_dir):
    t = toc(spark, sf_dir).withColumn("data_offset", F.col("doc_id") * 512)
    return layout.misaligned(t).select("path", "data_offset")


def misaligned_count(spark, sf_dir):
    return misaligned(spark, sf_dir).agg(F.count("*").alias("n"))


def labelled(spark, sf_dir) -> DataFrame:
    """Ids that other tables name, as wanted keys: (wanted, quality, toxic)."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("wanted"), "quality", "toxic")


def exists(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("wanted"))
    return catalog.exists(wanted, assets(spark, sf_dir), F.col("wanted"), F.col("doc_id"))


def lookup(spark, sf_dir):
    wanted = labelled(spark, sf_dir).select(F.col("wanted").alias("asset_id"))
    return catalog.lookup(toc(spark, sf_dir).withColumn("asset_id", F.col("doc_id")), wanted).select("path", "original_size")


def _entries(spark, sf_dir):
    t = toc(spark, sf_dir).withColumn("asset_id", F.col("doc_id").cast("string")).withColumn("data_offset", F.col("doc_id") * 4096).withColumn("chunk_count", F.lit(1))
    return t, t.join(labelled(spark, sf_dir), t["doc_id"] == F.col("wanted"), "left_semi").select("asset_id", "path")


def id_to_name(spark, sf_dir):
    return catalog.package_entries(*_entries(spark, sf_dir))


def package_summary(spark, sf_dir):
    return catalog.package_summary(*_entries(spark, sf_dir))


def matched_paths(spark, sf_dir):
    a = assets(spark, sf_dir)
    wanted = a.join(labelled(spark, sf_dir), a["doc_id"] == F.col("wanted"), "left_semi").select("path")
    return catalog.matched(wanted, toc(spark, sf_dir).select("path", "original_size"))


def _layers(spark, sf_dir):
    """All assets; over them those with a good label, in upper case; over them the toxic ones, changed in size."""
    a = assets(spark, sf_dir).select("doc_id", "path", "size")
    known = labelled(spark, sf_dir)
    some = lambda which: a.join(known.filter(which), a["doc_id"] == F.col("wanted"), "left_semi")
    return [a, some("quality = 1").withColumn("path", F.upper("path")), some("toxic = 1").withColumn("size", F.col("size") + 1)]


def overlay(spark, sf_dir):
    return catalog.overlay(catalog.mounted(_layers(spark, sf_dir))).select("path", F.col("layer").cast("long").alias("layer"), "size")


DUCK_LAYERS = f"""a as ({DUCK_A}), l as (select 0 as layer, doc_id, path, size from a union all select 1, doc_id, upper(path), size from a where doc_id in (select doc_id from labels where quality = 1) union all select 2, doc_id, path, size + 1 from a where doc_id in (select doc_id from labels where toxic = 1)),
view as (select * from l qualify row_number() over (partition by lower(path) order by layer desc, path desc) = 1)"""


def loose_override(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    return catalog.loose_override(catalog.mounted([layers[2]]), catalog.mounted(layers[:2])).select("path", "size")


def source_of(spark, sf_dir):
    view = catalog.overlay(catalog.mounted(_layers(spark, sf_dir))).withColumn("source", F.concat(F.lit("/mnt/packs/pack_"), F.col("layer").cast("string"), F.lit(".gtoc")))
    return catalog.source_of(assets(spark, sf_dir).select("path"), view).select("path", "source_archive")


def patch(spark, sf_dir):
    h = hashed(spark, sf_dir)
    known = labelled(spark, sf_dir)
    base = h.join(known.filter("toxic = 1 and quality = 1"), h["doc_id"] == F.col("wanted"), "left_anti")
    new = h.join(known, h["doc_id"] == F.col("wanted"), "left").filter("quality is null or quality = 1")
    return catalog.difference(base, new.withColumn("content_hash", F.when(F.col("quality") == 1, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))))


def method_totals(spark, sf_dir):
    return catalog.method_totals(toc(spark, sf_dir).withColumn("method", meta.method_name(F.col("flags"))))


def name_bytes(spark, sf_dir):
    return catalog.name_bytes(assets(spark, sf_dir))


def dedup_groups(spark, sf_dir):
    return layout.dedup_groups(hashed(spark, sf_dir))


def first_of_hash(spark, sf_dir):
    return layout.first_of_hash(hashed(spark, sf_dir)).select("content_hash", "path")


def distinct_first(spark, sf_dir):
    return catalog.distinct_first(hashed(spark, sf_dir), "content_hash", [F.col("doc_id")]).select("doc_id", "path")


def gap(spark, sf_dir):
    return layout.gaps(placed(spark, sf_dir)).select("path", "gap")


def slack(spark, sf_dir):
    return layout.slack(layout.gaps(placed(spark, sf_dir)))


def take_while(spark, sf_dir):
    return ordered.take_while(assets(spark, sf_dir), [F.col("doc_id")], F.col("size"), 1_000_000).select("doc_id", "size")


def preview(spark, sf_dir):
    return catalog.preview(assets(spark, sf_dir, "text"), "text", 100).select("path", "preview")


def listing(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return catalog.listing(assets(spark, sf_dir).select("path", "size"), pages)


def pending_files(spark, sf_dir):
    return catalog.pending(listing(spark, sf_dir)).select("path", "size")


def bytes_read(spark, sf_dir):
    return catalog.bytes_read(assets(spark, sf_dir, "text"), "text")


def path_helpers(spark, sf_dir):
    p = F.col("path")
    return assets(spark, sf_dir).select("path", meta.file_name(p).alias("name"), meta.extension(p).alias("ext"), meta.change_extension(p, ".gdat").alias("changed"))


def derive_key(spark, sf_dir):
    return assets(spark, sf_dir).select("path", F.hex(crypto.derive_key(F.col("path"))).alias("key"))


def _stored(spark, sf_dir, method: int, level: int) -> DataFrame:
    a = assets(spark, sf_dir, "text").withColumn("content", F.col("text").cast("binary")).select("path", "content")
    return chunks.encode(chunks.split(a, chunk=CHUNK), F.lit(method), level)


def _roundtrip(method: int, level: int):
    def query(spark, sf_dir):
        back = chunks.restore(_stored(spark, sf_dir, method, level), F.lit(method))
        return back.select("path", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("size"))

    return query


def encrypted_table(spark, sf_dir):
    a = assets(spark, sf_dir)
    key = crypto.derive_key(F.lit("a passphrase"))
    table = F.unhex(F.concat(F.hex(dds.to_le_u32(F.col("size"))), F.hex(dds.to_le_u32(F.col("doc_id")))))
    back = crypto.decrypt_table(crypto.encrypt_table(table, key), key)
    return a.select("path", back.alias("t")).select("path", F.hex("t").alias("chunk_table"))


def verify_chunks(spark, sf_dir):
    s = chunks.decodes(_stored(spark, sf_dir, S.ZSTD, 3), F.lit(S.ZSTD), ["path"])
    return s.groupBy("path").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("chunks"))


def asset_id(spark, sf_dir):
    return assets(spark, sf_dir).select("path", ids.asset_id(F.col("path")).alias("asset_id"))


def content_hash64(spark, sf_dir):
    return assets(spark, sf_dir, "text").select("path", ids.content_hash(F.col("text").cast("binary")).alias("hash"))


def _textures(spark, sf_dir):
    """Textures with real headers, made from the document numbers."""
    i = F.col("doc_id")
    w, h, mips = F.lit(2).cast("long") * F.pow(F.lit(2.0), i % 10).cast("long"), F.lit(4).cast("long") * F.pow(F.lit(2.0), i % 9).cast("long"), i % 12
    le = dds.to_le_u32
    pad = lambda n: F.unhex(F.repeat(F.lit("00"), n))
    four = F.when(i % 3 == 0, F.lit(dds.FOURCC_DXT1)).when(i % 3 == 1, F.lit(dds.FOURCC_DX10)).otherwise(F.lit(0x35545844)).cast("long")
    head = F.concat(le(F.lit(dds.MAGIC).cast("long")), le(F.lit(dds.HEADER_SIZE).cast("long")), pad(4), le(h), le(w), pad(8), le(mips), pad(52), le(four), pad(40))
    body = F.unhex(F.repeat(F.hex(F.substring(F.sha2(i.cast("string"), 256), 1, 8)), ((i % 50) * 400 + 100).cast("int")))
    return assets(spark, sf_dir).select("path", "doc_id", w.alias("w"), h.alias("h"), F.concat(head, body).alias("content"))


def dds_header(spark, sf_dir):
    return _textures(spark, sf_dir).select("path", dds.header(F.col("content")).alias("t")).select("path", "t.*")


def mip_split(spark, sf_dir):
    t = _textures(spark, sf_dir).withColumn("plan", dds.split_plan(F.col("content")))
    out = dds.split_rewrite(F.col("content"), F.col("plan"))
    return t.withColumn("new", out).select("path", "plan.*", F.col("new.tail_size").alias("tail_size"), F.sha2("new.content", 256).alias("sha"))


def path_rank(spark, sf_dir):
    """Places in path order (G1), without one task that sorts all."""
    return ordered.running(assets(spark, sf_dir), ordered.by_path(), {"rank": F.lit(1)}, inclusive=True).select("path", F.col("rank").cast("long").alias("rank"))


def id_rank(spark, sf_dir):
    return ordered.running(assets(spark, sf_dir), [F.col("doc_id")], {"rank": F.lit(1)}, inclusive=True).select("doc_id", F.col("rank").cast("long").alias("rank"))


def offset_rank(spark, sf_dir):
    return ordered.running(placed(spark, sf_dir), [F.col("data_offset"), F.col("path")], {"rank": F.lit(1)}, inclusive=True).select("path", F.col("rank").cast("long").alias("rank"))


def encode_texture(spark, sf_dir):
    i = F.col("doc_id")
    m1, m2 = meta.encode_texture(i * 37, i * 11 + 1, i % 300, F.col("size") * 1013)
    return assets(spark, sf_dir).select("path", m1.alias("meta1"), m2.alias("meta2"))


def size_text(spark, sf_dir):
    return assets(spark, sf_dir).select("path", meta.size_label(F.col("size") * 1013).alias("label"))


def method_text(spark, sf_dir):
    t = toc(spark, sf_dir).withColumn("percent", (F.col("doc_id") % 2001) / 16)
    return t.select("path", meta.method_label(F.lit(False), meta.method_name(F.col("flags")), F.col("doc_id") % 3 == 0, F.col("percent")).alias("label"))


def keyed(spark, sf_dir):
    return catalog.to_map(assets(spark, sf_dir), "path").select("path", "size")


def content_hash_known(spark, sf_dir):
    """Published XXH64 values, seed 0."""
    rows = spark.createDataFrame([("",), ("a",), ("abc",), ("Nobody inspects the spammish repetition",)], "word string")
    return rows.select("word", F.lower(F.lpad(F.hex(ids.content_hash(F.col("word").cast("binary"))), 16, "0")).alias("hash"))


def mip_plan(spark, sf_dir):
    t = _textures(spark, sf_dir).withColumn("plan", dds.split_plan(F.col("content")))
    return t.select("path", "plan.*", dds.split_rewrite(F.col("content"), F.col("plan"))["tail_size"].alias("tail_size"))


def level_limits(spark, sf_dir):
    rows = [(m, n) for m, n in meta.MAX_LEVEL.items()]
    return spark.createDataFrame(rows, "method string, max_level long")


def _files(spark, sf_dir):
    return assets(spark, sf_dir, "text").select("path", F.col("text").cast("binary").alias("content"))


def _package(spark, sf_dir, method="Auto", passphrase=None) -> packages.Package:
    path = shared_dir(spark)
    packages.pack(_files(spark, sf_dir), path, method, 1, passphrase=passphrase, chunk=CHUNK)
    return packages.Package(spark, path, passphrase)


def package_contents(spark, sf_dir):
    return _package(spark, sf_dir).contents().select("path", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("size"))


def package_sealed(spark, sf_dir):
    return _package(spark, sf_dir, "Zstd", "secret words").contents().select("path", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("size"))


def package_chunks(spark, sf_dir):
    """Chunk tables as stored without compression, where they follow from the sizes (A5)."""
    p = _package(spark, sf_dir, "Store")
    return p.chunk_table().join(p.names, "asset_id").select("path", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("original_size").cast("long").alias("chunk_size"))


def package_verified(spark, sf_dir):
    return spark.createDataFrame([(_package(spark, sf_dir).all_ok(),)], "ok boolean")


def _archive(spark, sf_dir, passphrase=None):
    """A package as archive files, and their table of contents read back by rows."""
    p = _package(spark, sf_dir, "Zstd", passphrase)
    folder = shared_dir(spark).removeprefix("file://")
    os.makedirs(folder)
    table, data = f"{folder}/a.gtoc", f"{folder}/a.gdat"
    archive_format.write_archive(p, table, data)
    archive_format.register(spark)
    return spark.read.format("parcel_toc").option("rowsPerPartition", "500").load(table), table, data


def _archived(passphrase):
    def query(spark, sf_dir):
        rows, table, data = _archive(spark, sf_dir, passphrase)
        found = archive_format.read_contents(rows.join(archive_format.read_names(spark, table), "asset_id"), table, data, passphrase)
        return found.select("path", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("size"))

    return query


def archive_toc(spark, sf_dir):
    rows, table, _ = _archive(spark, sf_dir)
    return rows.join(archive_format.read_names(spark, table), "asset_id").select("path", "original_size", F.col("chunk_count").cast("long").alias("chunk_count"))


QUERIES = {f.__name__: f for f in (
    layout_offsets, shared_offsets, toc_pointer, chunk_sizes, chunk_offsets, chunk_at_position, batch_rebase, nested_sum, encode_flags, decode_flags, choose_method, texture_info, ratio,
    display_info, size_label, method_label, block_map, list_label, search, suffix, gdeflate_only, misaligned, misaligned_count, exists, lookup, id_to_name, package_summary, matched_paths,
    overlay, loose_override, source_of, patch, method_totals, name_bytes, dedup_groups, first_of_hash, distinct_first, gap, slack, take_while, preview, listing, pending_files, bytes_read,
    path_helpers, derive_key, encrypted_table, verify_chunks, asset_id, content_hash64, dds_header, mip_split,
    path_rank, id_rank, offset_rank, encode_texture, size_text, method_text, keyed, content_hash_known, mip_plan, level_limits, package_contents, package_sealed, package_chunks, package_verified, archive_toc,
)} | {"archive_contents": _archived(None), "archive_sealed": _archived("secret words")} | {"roundtrip_zstd": _roundtrip(S.ZSTD, 3), "roundtrip_lz4": _roundtrip(S.LZ4, 9), "roundtrip_store": _roundtrip(S.STORE, 1)}

_CS = f"select path, size, unnest(range(greatest(1, cast(ceil(size / {CHUNK}.0) as bigint)))) as i from a"
_CHUNKS = f"a as ({DUCK_A}), c as (select path, cast(i as int) as chunk_idx, cast(least({CHUNK}, size - i * {CHUNK}) as bigint) as chunk_size from ({_CS}))"
_ROUND = f"select path, sha256(text) as sha, size from ({DUCK_A})"
_NAMES = "case (flags & 28) >> 2 when 0 then 'Store' when 1 then 'GDeflate' when 2 then 'Zstd' else 'LZ4' end"
_INFO = "concat((meta1 >> 16)::varchar, 'x', (meta1 & 65535)::varchar, ' M:', (meta2 >> 24)::varchar, case when (meta2 & 16777215) > 0 then concat(' T:', ((meta2 & 16777215) // 1024)::varchar, 'KB') else '' end)"

ORACLE_SQL = {
    "layout_offsets": f"with {DUCK_PLACED} select path, data_offset from placed",
    "shared_offsets": f"with {DUCK_PLACED}, k as (select f.path as lead, sha256(f.text) as h from f where rn = 1) select a.path, p.data_offset from a join k on sha256(a.text) = k.h join placed p on p.path = k.lead",
    "toc_pointer": f"with a as ({DUCK_A}), h as (select 64 + count(*) * 56 + sum(18 + strlen(path)) as base from a) select path, cast(base + coalesce(sum(8 * greatest(1, cast(ceil(size / {CHUNK}.0) as bigint))) over (order by upper(path), path rows between unbounded preceding and 1 preceding), 0) as bigint) as chunk_table_offset from a, h",
    "chunk_sizes": f"with {_CHUNKS} select * from c",
    "chunk_offsets": f"with {_CHUNKS} select *, cast(coalesce(sum(chunk_size) over (partition by path order by chunk_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as chunk_offset from c",
    "chunk_at_position": f"with a as ({DUCK_A}) select path, cast(floor(size * 2 / 3) as bigint) as pos, cast(cast(floor(size * 2 / 3) as bigint) // {CHUNK} as int) as chunk_idx, cast(cast(floor(size * 2 / 3) as bigint) % {CHUNK} as bigint) as in_chunk from a where size > 0",
    "batch_rebase": f"with {_CHUNKS} select path, chunk_idx, cast(coalesce(sum(chunk_size) over (order by upper(path), path, chunk_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as batch_offset from c",
    "nested_sum": f"with {_CHUNKS} select path, cast(sum(ceil(chunk_size * 0.5)) as bigint) as sum_compressed, cast(sum(chunk_size) as bigint) as sum_original from c group by path",
    "encode_flags": f"select path, flags from ({DUCK_TOC})",
    "decode_flags": f"select path, {_NAMES} as method, cast(align as bigint) as alignment, (flags & 2) <> 0 as encrypted, method = 1 as texture from ({DUCK_TOC})",
    "choose_method": f"select path, method::bigint as method, align::bigint as align from ({DUCK_A})",
    "texture_info": f"select path, {_INFO} as info from ({DUCK_TOC}) where (flags & 224) = 32",
    "ratio": f"select path, case when original_size > 0 then compressed_size / original_size * 100 else 0.0 end as ratio from ({DUCK_TOC})",
    "display_info": f"select doc_id, case when length(path) > 15 then concat('...', right(path, 12)) else path end as shown, cast(original_size // 1024 as bigint) as kb from ({DUCK_TOC})",
    "size_label": f"select path, case when original_size < 1024 then 'B' else 'MB' end as unit, case when original_size < 1024 then original_size::double else original_size / 1048576.0::double end as amount, case when original_size < 1024 then concat(original_size::varchar, ' B') end as label from ({DUCK_TOC})",
    "method_label": f"select path, case when doc_id % 7 = 0 then 'Pending' else concat({_NAMES}, case when doc_id % 3 = 0 then ' [Enc]' else '' end, ' (', cast(floor(case when original_size > 0 then compressed_size / original_size * 100 else 0 end) as bigint)::varchar, '%)') end as label from ({DUCK_TOC})",
    "block_map": f"with t as ({DUCK_TOC}), s as (select sum(compressed_size) as total from t) select path, least(100.0::double, greatest(2.0::double, compressed_size::double * 2000 / greatest(total, 1)::double)) as width, case {_NAMES} when 'GDeflate' then 'LimeGreen' when 'Zstd' then 'DodgerBlue' when 'LZ4' then 'Orange' else 'Gray' end as colour from t, s",
    "list_label": f"select path, case when lower(path) like '%.dds' then 'image' else 'file' end as icon, concat(path, chr(10), '[', sha256(path), ']') as label from ({DUCK_A})",
    "search": f"select path from ({DUCK_A}) where contains(lower(path), lower('DOC_1'))",
    "suffix": f"select path, lower(path) like '%.dds' as any_case, path like '%.dds' as exact_case from ({DUCK_A})",
    "gdeflate_only": f"select path, flags from ({DUCK_TOC}) where (flags & 28) = 4",
    "misaligned": f"select path, doc_id * 512 as data_offset from ({DUCK_TOC}) where (flags & 28) = 4 and (doc_id * 512) % 4096 <> 0",
    "misaligned_count": f"select count(*) as n from ({DUCK_TOC}) where (flags & 28) = 4 and (doc_id * 512) % 4096 <> 0",
    "exists": f"select o_orderkey as wanted from orders where o_orderkey in (select doc_id from ({DUCK_A}))",
    "lookup": f"select path, original_size from ({DUCK_TOC}) where doc_id in (select doc_id from labels)",
    "id_to_name": f"select case when doc_id in (select doc_id from labels) then path else doc_id::varchar end as path, doc_id::varchar as asset_id, doc_id * 4096 as offset, original_size, compressed_size, align::bigint as alignment, {_NAMES} as method, case when (flags & 224) = 32 then {_INFO} end as metadata_info from ({DUCK_TOC})",
    "package_summary": f"with t as ({DUCK_TOC}) select count(*) as file_count, cast(max(doc_id * 4096 + compressed_size) as bigint) as data_bytes, cast(sum(case when doc_id in (select doc_id from labels) then 18 + strlen(path) else 0 end) as bigint) as name_bytes, cast(64 + count(*) * 56 + sum(case when doc_id in (select doc_id from labels) then 18 + strlen(path) else 0 end) + 8 * count(*) as bigint) as toc_bytes from t",
    "matched_paths": f"select path, original_size from ({DUCK_TOC}) where doc_id in (select doc_id from labels)",
    "overlay": f"with {DUCK_LAYERS} select path, layer::bigint as layer, size from view",
    "loose_override": f"with {DUCK_LAYERS} select path, size from l where layer = 2 union all select path, size from (select * from l where layer < 2 qualify row_number() over (partition by lower(path) order by layer desc, path desc) = 1) where lower(path) not in (select lower(path) from l where layer = 2)",
    "source_of": f"with {DUCK_LAYERS} select a.path, case when view.layer is null then 'None' else concat('pack_', view.layer::varchar, '.gtoc') end as source_archive from a left join view on lower(a.path) = lower(view.path)",
    "patch": f"with h as (select doc_id, path, sha256(text) as s from ({DUCK_A})), b as (select * from h where doc_id not in (select doc_id from labels where toxic = 1 and quality = 1)), n as (select doc_id, path, case when quality = 1 then sha256(s) else s end as s from h left join labels using (doc_id) where quality is null or quality = 1) select coalesce(n.path, b.path) as path, case when b.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change from b full join n on b.path = n.path where b.path is null or n.path is null or b.s <> n.s",
    "method_totals": f"select {_NAMES} as method, count(*) as n, sum(compressed_size)::bigint as compressed, sum(original_size)::bigint as original from ({DUCK_TOC}) group by 1",
    "name_bytes": f"select cast(sum(18 + strlen(path)) as bigint) as name_bytes from ({DUCK_A})",
    "dedup_groups": f"select sha256(text) as content_hash, count(*) as n, cast(sum(size) - max(size) as bigint) as saved from ({DUCK_A}) group by 1 having count(*) > 1",
    "first_of_hash": f"with a as ({DUCK_A}) select sha256(text) as content_hash, path from a qualify row_number() over (partition by sha256(text) order by upper(path), path) = 1",
    "distinct_first": f"with a as ({DUCK_A}) select doc_id, path from a qualify row_number() over (partition by sha256(text) order by doc_id) = 1",
    "gap": f"with {DUCK_PLACED} select path, cast(data_offset - lag(data_offset + size) over (order by data_offset, path) as bigint) as gap from placed",
    "slack": f"with {DUCK_PLACED}, q as (select size, data_offset - lag(data_offset + size) over (order by data_offset, path) as gap from placed) select cast(coalesce(sum(case when gap > 0 and gap < 131072 then gap end), 0) as bigint) as slack_bytes, cast(sum(size) as bigint) as data_bytes, coalesce(sum(case when gap > 0 and gap < 131072 then gap end), 0) * 100.0::double / sum(size) as slack_percent from q",
    "take_while": f"with a as ({DUCK_A}), r as (select *, sum(size) over (order by doc_id rows between unbounded preceding and current row) as s from a) select doc_id, size from r where s <= 1000000",
    "preview": f"select path, substr(text, 1, 100) as preview from ({DUCK_A})",
    "listing": f"select path, size, false as pending from ({DUCK_A}) union all select url, cast(strlen(html) as bigint), true from pages",
    "pending_files": "select url as path, cast(strlen(html) as bigint) as size from pages",
    "bytes_read": f"select cast(sum(size) as bigint) as bytes from ({DUCK_A})",
    "path_helpers": f"select path, split_part(path, '/', 3) as name, case when doc_id % 5 = 0 then '.DDS' else '.json' end as ext, concat(split_part(path, '.', 1), '.gdat') as changed from ({DUCK_A})",
    "derive_key": f"select path, upper(sha256(path)) as key from ({DUCK_A})",
    "roundtrip_zstd": _ROUND,
    "roundtrip_lz4": _ROUND,
    "roundtrip_store": _ROUND,
    "encrypted_table": "select path, concat(" + ", ".join(f"printf('%02X', ({c} >> {8 * b}) & 255)" for c in ("size", "doc_id") for b in range(4)) + f") as chunk_table from ({DUCK_A})",
    "dds_header": f"select path, cast(2 * power(2, doc_id % 10) as int) as width, cast(4 * power(2, doc_id % 9) as int) as height, cast(greatest(1, doc_id % 12) as int) as mip_count, cast(case doc_id % 3 when 0 then {dds.FOURCC_DXT1} when 1 then {dds.FOURCC_DX10} else {0x35545844} end as bigint) as four_cc from ({DUCK_A})",
    "verify_chunks": f"select path, true as ok, greatest(1, cast(ceil(size / {CHUNK}.0) as bigint)) as chunks from ({DUCK_A})",
    "path_rank": f"with a as ({DUCK_A}) select path, row_number() over (order by upper(path), path) as rank from a",
    "id_rank": f"with a as ({DUCK_A}) select doc_id, row_number() over (order by doc_id) as rank from a",
    "offset_rank": f"with {DUCK_PLACED} select path, row_number() over (order by data_offset, path) as rank from placed",
    "encode_texture": f"select path, cast((((doc_id * 37) & 65535) << 16) | ((doc_id * 11 + 1) & 65535) as bigint) as meta1, cast((((doc_id % 300) & 255) << 24) | ((size * 1013) & 16777215) as bigint) as meta2 from ({DUCK_A})",
    "size_text": f"select path, case when size * 1013 < 1024 then concat((size * 1013)::varchar, ' B') else printf('%.2f MB', size * 1013 / 1048576.0::double) end as label from ({DUCK_A})",
    "method_text": f"select path, concat({_NAMES}, case when doc_id % 3 = 0 then ' [Enc]' else '' end, ' (', cast(round((doc_id % 2001) / 16) as bigint)::varchar, '%)') as label from ({DUCK_TOC})",
    "keyed": f"select path, size from ({DUCK_A})",
    "content_hash_known": "select * from (values ('', 'ef46db3751d8e999'), ('a', 'd24ec4f1a98c6e5b'), ('abc', '44bc2cf5ad770999'), ('Nobody inspects the spammish repetition', 'fbcea83c8a378bf1')) as t(word, hash)",
    "mip_plan": f"""with t as (select path, cast(2 * power(2, doc_id % 10) as bigint) as w, cast(4 * power(2, doc_id % 9) as bigint) as h, greatest(1, doc_id % 12) as mips, case when doc_id % 3 = 1 then 148 else 128 end as head,
  case when doc_id % 3 = 0 then 8 else 16 end as block, 128 + 8 * ((doc_id % 50) * 400 + 100) as n from ({DUCK_A})),
l as (select *, unnest(range(mips)) as i from t), s as (select *, greatest(1, w >> i) as wi, greatest(1, h >> i) as hi from l),
c as (select path, min(i) filter (wi <= 128 and hi <= 128) as cut from s group by path),
o as (select s.path, c.cut, any_value(head) + coalesce(sum(((wi + 3) // 4) * ((hi + 3) // 4) * block) filter (s.i < c.cut), 0) as off, any_value(wi) filter (s.i = c.cut) as cw, any_value(hi) filter (s.i = c.cut) as ch from s join c using (path) group by s.path, c.cut),
v as (select t.*, o.*, (w > 128 or h > 128) and cut is not null and off < n as ok from t join o on t.path = o.path)
select path, case when ok then head::bigint end as header_size, case when ok then off::bigint end as split_offset, case when ok then cut::int end as cut, case when ok then cw::int end as width, case when ok then ch::int end as height, case when ok then (mips - cut)::int end as mips, (case when ok then head + n - off else n end)::bigint as tail_size from v""",
    "level_limits": "select * from (values ('Zstd', 22::bigint), ('LZ4', 12), ('GDeflate', 12), ('Auto', 12), ('Store', 1)) as t(method, max_level)",
    "package_contents": _ROUND,
    "package_sealed": _ROUND,
    "package_chunks": f"with {_CHUNKS} select path, chunk_idx, chunk_size from c",
    "package_verified": "select true as ok",
    "archive_contents": _ROUND,
    "archive_sealed": _ROUND,
    "archive_toc": f"select path, size as original_size, greatest(1, cast(ceil(size / {CHUNK}.0) as bigint)) as chunk_count from ({DUCK_A})",
}
