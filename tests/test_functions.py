import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelyard import schema as S
from parcelyard.functions import codecs, crypto, dds, ids, meta


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(col.alias("x")).first()["x"]


def test_asset_id_known_and_folding():
    assert ids.asset_id_of("textures/a.dds") == "33952831-86b8-f248-9052-e4e923459504"
    assert ids.asset_id_of("Textures\\A.DDS") == ids.asset_id_of("textures/a.dds")
    assert ids.asset_id_of("") == "00000000-0000-0000-0000-000000000000"
    assert ids.asset_id_of(None) is None


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), min_size=1))
def test_asset_id_ignores_case(path):
    assert ids.asset_id_of(path.upper()) == ids.asset_id_of(path.lower())


def test_hashes():
    assert ids.xxh64(b"") == 0xEF46DB3751D8E999
    assert ids.xxh64(b"abc") == xxhash.xxh64_intdigest(b"abc")
    assert ids.xxh64_compat(b"") == 0x27D4EB2F165667C5


def test_flags_round_trip(spark):
    for m in range(4):
        for align in (16, 4096):
            f = one(spark, meta.encode_flags(F.col("m"), F.col("a"), F.col("e"), F.col("t")), m=m, a=align, e=True, t=False)
            assert f & S.FLAG_CHUNKED and f & S.FLAG_ENCRYPTED and bool(f & 1) == (m != 0)
            assert one(spark, meta.method_name(F.col("f")), f=f) == S.METHOD_NAMES[m]
            assert one(spark, meta.decode_alignment(F.col("f")), f=f) == align


def test_texture_text(spark):
    m1, m2 = meta.encode_texture(F.col("w"), F.col("h"), F.col("m"), F.col("t"))
    assert one(spark, meta.texture_info(m1, m2), w=1024, h=512, m=11, t=0) == "1024x512 M:11"
    assert one(spark, meta.texture_info(m1, m2), w=1024, h=512, m=11, t=5000) == "1024x512 M:11 T:4KB"


def test_labels(spark):
    assert one(spark, meta.ratio(F.col("c"), F.col("o")), c=5, o=0) == 0
    assert one(spark, meta.show_path(F.col("p")), p="x" * 60) == "..." + "x" * 47
    assert one(spark, meta.size_label(F.col("n")), n=1023) == "1023 B"
    assert one(spark, meta.size_label(F.col("n")), n=3 << 20) == "3.00 MB"
    assert one(spark, meta.block_width(F.col("c"), F.col("t")), c=0, t=0) == 2
    assert one(spark, meta.change_extension(F.col("p"), ".gdat"), p="a.b/c.x") == "a.b/c.gdat"
    with pytest.raises(ValueError):
        meta.check_level("Zstd", 23)


def header(w, h, mips, four=b"DXT1", size=124):
    head = struct.pack("<4sIIIIIII", b"DDS ", size, 0, h, w, 7, 0, mips) + bytes(52) + four + bytes(40)
    assert len(head) == 128
    return head + (bytes(20) if four == b"DX10" else b"")


def brute_split(data, top=128):
    """The cut by walking the levels one by one."""
    if len(data) < 128 or data[:4] != b"DDS " or struct.unpack_from("<I", data, 4)[0] != 124:
        return None
    h, w = struct.unpack_from("<II", data, 12)
    mips = max(1, struct.unpack_from("<I", data, 28)[0])
    if w <= top and h <= top:
        return None
    at = 148 if data[84:88] == b"DX10" else 128
    block = 8 if data[84:88] == b"DXT1" else 16
    lw, lh = w, h
    for i in range(mips):
        if lw <= top and lh <= top:
            return (at, i, max(1, w >> i), max(1, h >> i), mips - i) if at < len(data) else None
        at += max(1, (lw + 3) // 4) * max(1, (lh + 3) // 4) * block
        lw, lh = max(1, lw // 2), max(1, lh // 2)
    return None


def test_mip_split_against_walk(spark):
    cases = []
    for w, h, m in ((512, 256, 10), (1024, 1024, 3), (128, 128, 8), (300, 7, 9), (4096, 16, 0), (256, 256, 2), (7, 2048, 12)):
        for four in (b"DXT1", b"DX10", b"DXT5"):
            for tail in (0, 100, 200_000, 700_000):
                cases.append(header(w, h, m, four) + bytes(i % 251 for i in range(tail)))
    cases += [b"", b"DDS ", header(512, 512, 9, size=100) + bytes(300_000), b"XXXX" + header(512, 512, 9)[4:] + bytes(300_000)]
    df = spark.createDataFrame(list(enumerate(bytearray(c) for c in cases)), "i int, c binary").withColumn("p", dds.split_plan(F.col("c")))
    got = {r["i"]: r for r in df.select("i", "p", dds.split_rewrite(F.col("c"), F.col("p")).alias("n")).collect()}
    cut = 0
    for i, c in enumerate(cases):
        want, row = brute_split(c), got[i]
        if want is None:
            assert row["p"] is None and bytes(row["n"]["content"]) == c and row["n"]["tail_size"] == len(c)
            continue
        cut += 1
        p = row["p"]
        assert (p["split_offset"], p["cut"], p["width"], p["height"], p["mips"]) == want
        new, head = bytes(row["n"]["content"]), p["header_size"]
        assert len(new) == len(c) and row["n"]["tail_size"] == head + len(c) - want[0]
        assert struct.unpack_from("<IIIII", new, 12) [:3] == (want[3], want[2], 0) and struct.unpack_from("<I", new, 28)[0] == want[4]
        assert new[head:] == c[want[0]:] + c[head : want[0]]
    assert cut > 10


def test_codecs():
    import os

    noise, text = os.urandom(5000), b"abc" * 5000
    for m in (S.STORE, S.ZSTD, S.LZ4, S.GDEFLATE):
        for raw in (b"", b"x", noise, text):
            assert codecs.decompress_bytes(codecs.compress_bytes(raw, m, 9), len(raw), m) == raw
    assert codecs.compress_bytes(noise, S.ZSTD, 3) == noise
    assert len(codecs.compress_bytes(text, S.ZSTD, 3)) < 200
    with pytest.raises(NotImplementedError):
        codecs.decompress_bytes(b"ab", 10, S.GDEFLATE)
    with pytest.raises(Exception):
        codecs.decompress_bytes(codecs.compress_bytes(text, S.ZSTD, 3)[:-4], len(text), S.ZSTD)
    assert codecs.available("Zstd") and codecs.available("Store") and not codecs.available("GDeflate")


def test_lz4_levels():
    import random

    rng = random.Random(1)
    raw = " ".join(f"w{rng.randrange(300)}" for _ in range(20_000)).encode()
    sizes = [len(codecs.compress_bytes(raw, S.LZ4, k)) for k in (1, 3, 4, 9, 12)]
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3] >= sizes[4]
    assert codecs.decompress_bytes(codecs.compress_bytes(raw, S.LZ4, 12), len(raw), S.LZ4) == raw


def test_chunk_table_encryption(spark):
    key = crypto.derive_key(F.lit("k"))
    sealed = one(spark, crypto.encrypt_table(F.col("t").cast("binary"), key), t="12345678" * 3)
    assert len(sealed) == 24 + 28
    row = spark.createDataFrame([(bytearray(sealed),)], "s binary")
    assert bytes(row.select(crypto.decrypt_table(F.col("s"), key).alias("x")).first()["x"]) == b"12345678" * 3
    with pytest.raises(Exception):
        row.select(crypto.decrypt_table(F.col("s"), crypto.derive_key(F.lit("other"))).alias("x")).collect()
