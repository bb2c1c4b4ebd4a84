"""Compression and hashing of binary values."""

import os
import re
from pathlib import Path

import psutil
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowquarry.functions.blob import BLOCK_BYTES, block_size, compress, decompress, hash_blob
from rowquarry.functions.encoding import text_column, to_utf8

SIZES = [1, 100, BLOCK_BYTES - 1, BLOCK_BYTES, BLOCK_BYTES + 1, 100_000, 1_000_000]


@pytest.fixture(scope="module")
def blobs(spark):
    data = [(n, os.urandom(n // 2) + bytes(n - n // 2)) for n in SIZES] + [(0, None)]
    return spark.createDataFrame(data, "n int, x binary").cache()


@pytest.mark.parametrize("how", [("LZ4", 0), ("LZ4", 100), ("ZSTD", 0), ("ZSTD", 100)])
@pytest.mark.parametrize("hash_", [False, True])
def test_round_trip(blobs, how, hash_):
    packed = compress("x", *how, hash=hash_)
    got = blobs.select("n", decompress(packed).eqNullSafe(F.col("x")).alias("same"), F.length(packed).alias("size")).collect()
    assert all(r.same for r in got)
    sizes = {r.n: r["size"] for r in got}
    assert sizes[1_000_000] < 600_000 and sizes[0] is None


def test_blocks():
    assert block_size(10) == BLOCK_BYTES and block_size(48 * BLOCK_BYTES) == BLOCK_BYTES
    assert -(-1_000_000 // block_size(1_000_000)) == 48


def worker_mb(what):
    """This line of /proc/PID/status, in MB, of each Python worker and of what forks them."""
    found = {}
    for p in psutil.Process().children(recursive=True):
        if "pyspark.daemon" in " ".join(p.cmdline()):
            found[p.pid] = int(re.search(rf"{what}:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) / 1024
    return found


@pytest.mark.parametrize("how", [("LZ4", 0, False), ("ZSTD", 50, True)])
def test_workers_memory_does_not_grow_with_the_batch(spark, how):
    """170 MB of values in one task, which compressed are one small batch."""
    big = spark.range(0, 150, 1, 1).select(F.expr("cast(repeat(concat('value ', id), 130000) as binary)").alias("x"))
    small = spark.range(0, 1, 1, 1).select(F.lit(b"x").alias("x"))
    same = decompress(compress("x", *how)).eqNullSafe(F.col("x"))
    assert small.agg(F.every(same)).first()[0]
    for pid in (before := worker_mb("VmRSS")):
        Path(f"/proc/{pid}/clear_refs").write_text("5")  # VmHWM starts anew
    assert tuple(big.agg(F.every(same), F.count("*")).first()) == (True, 150)
    grown = {pid: mb - before.get(pid, min(before.values())) for pid, mb in worker_mb("VmHWM").items()}
    assert len(grown) >= 3 and max(grown.values()) < 60


def failing(df, column):
    with pytest.raises(PySparkException) as e:
        df.select(F.length(column)).collect()
    return str(e.value)


def damaged(packed, at):
    """The column with the byte at this 1-based place changed."""
    byte = F.conv(F.hex(packed.substr(at, 1)), 16, 10).cast("int")
    other = F.unhex(F.lpad(F.hex((byte + 1) % 256), 2, "0"))
    return F.concat(packed.substr(F.lit(1), F.lit(at - 1)), other, packed.substr(F.lit(at + 1), F.length(packed)))


def test_damage_is_found(blobs):
    df = blobs.where("n = 100000")
    for hash_, message in ((False, "error was detected in the compressed data"), (True, "Incorrect input vector")):
        packed = df.select(compress("x", hash=hash_).alias("p"))
        for at in (1, 6, 15, 21, 25, 33, 36):
            assert "Incorrect header information found" in failing(packed, decompress(damaged(F.col("p"), at)))
        assert message in failing(packed, decompress(damaged(F.col("p"), 5_000)))
        cut = F.col("p").substr(F.lit(1), F.length("p") - 1)
        assert message in failing(packed, decompress(cut))
    short = blobs.where("n = 1").select(F.lit(b"").alias("p"))
    assert "Incorrect header information found" in failing(short, decompress("p"))


def test_argument_errors(spark, blobs):
    with pytest.raises(ValueError, match="compressor"):
        compress("x", "GZIP")
    for bad in (-1, 101, "5", True):
        with pytest.raises(ValueError, match="compression"):
            compress("x", compression=bad)
    with pytest.raises(ValueError, match="hash seed"):
        hash_blob("x", seed="a")
    with pytest.raises(ValueError, match="block_hash"):
        hash_blob("x", block_hash=1)
    assert "Source contains no data" in failing(spark.createDataFrame([(b"",)], "x binary"), compress("x"))


def test_hashes(blobs):
    got = {
        r.n: r
        for r in blobs.select(
            "n", hash_blob("x").alias("block"), hash_blob("x", block_hash=False).alias("flat"), F.xxhash64("x").alias("native"),
            hash_blob("x", seed=3).alias("seeded"), hash_blob("x", seed=3, block_hash=False).alias("seeded_flat"),
        ).collect()
    }
    for n in SIZES:
        r = got[n]
        assert r.flat == r.native and r.seeded != r.block and r.seeded_flat != r.flat
        assert (r.block == r.flat) == (n <= BLOCK_BYTES) == (r.seeded == r.seeded_flat)
    assert got[0].block is None and got[0].flat is None
    assert len({r.block for r in got.values()}) == len(got)


def test_encodings(spark):
    word = "Ärende"
    data = [(word.encode("latin1"), "latin1"), (word.encode(), "UTF-8"), (word.encode(), "native"), (None, "latin1")]
    df = spark.createDataFrame(data, "x binary, enc string")
    assert [r[0] for r in text_column(df, "x", "enc").select("x").collect()] == [word, word, word, None]
    with pytest.raises(ValueError, match="mixed encodings"):
        text_column(df, "x", "enc", uniform_encoding=False)
    one = df.where("enc = 'latin1'")
    assert text_column(one, "x", "enc", uniform_encoding=False).first().x == word
    utf8 = df.where("enc <> 'latin1'").select(to_utf8(F.col("x"), "utf-8").alias("x"))
    assert utf8.where(F.col("x") == word).count() == 2
    with pytest.raises(PySparkException, match="Unknown encoding: ebcdic"):
        df.select(to_utf8(F.col("x"), F.lit("ebcdic"))).collect()
