"""Compression and hashing of binary values, as expressions on columns.

Container of a compressed value (integers big-endian, positions from 1):

    1-4    marker ``RQB1``
    5-12   xxHash64 of the header from byte 13 on
    13-20  xxHash64 of the payload
    21     codec: 1 LZ4, 2 ZSTD
    22     1 if the caller asked for the payload's hash to be reported on, else 0
    23-30  length of the raw value
    31-34  number of blocks
    35-    length of each compressed block (4 bytes each), then the blocks

Hashing, checks and errors are native expressions; only the codec itself runs in Arrow batches. Its
worker holds a batch of ``PIECE_BYTES``, one value and a piece of as many bytes of results, however
long the values are and however many there are.
The payload's hash is always stored and checked, as a codec may decode a damaged block to wrong
bytes without noticing; the flag only chooses the message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MARKER = b"RQB1"
CODECS = {"LZ4": 1, "ZSTD": 2}
#: Blocks hold at least so many bytes, and a value has about so many blocks at most.
BLOCK_BYTES = 16_384
BLOCKS = 48
#: Bytes that a worker gets at once, and those of results it holds before it hands them on; a value is never split.
PIECE_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
HASH_SEED = 42
#: ZSTD's highest level; the scale from 0 to 100 is spread over the levels from 1 on.
_ZSTD_TOP = 19


def _codec(name: str, compression: int) -> pa.Codec:
    if name == "LZ4":
        return pa.Codec("lz4_raw")
    return pa.Codec("zstd", compression_level=1 + compression * (_ZSTD_TOP - 1) // 100)


def block_size(length: int) -> int:
    return max(BLOCK_BYTES, -(-length // BLOCKS))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound_batches() -> None:
    """The session sends Python code at most ``PIECE_BYTES`` at once, or what it was set to if that is less."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > PIECE_BYTES:
        spark.conf.set(_BATCH_BYTES, str(PIECE_BYTES))


def _in_pieces(batches: Iterable[pa.Array], one: Callable[[bytes], bytes]) -> Iterator[pa.Array]:
    """``one`` of every value, null for null; neither a batch's values nor its results are ever held all at once."""
    for batch in batches:
        done, held = [], 0
        for value in batch:
            done.append(one(value.as_py()) if value.is_valid else None)
            held += len(done[-1] or b"")
            if held >= PIECE_BYTES:
                yield pa.array(done, pa.binary())
                done, held = [], 0
        if done:
            yield pa.array(done, pa.binary())


def _hash_bytes(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))


def _number(c: Column) -> Column:
    return F.conv(F.hex(c), 16, 10).cast("long")


def compress(x: Column | str, compressor: str = "ZSTD", compression: int = 0, hash: bool = False) -> Column:
    """The binary value compressed; null stays null, an empty value is an error."""
    if compressor not in CODECS:
        raise ValueError("Parameter compressor should be set to 'LZ4' or 'ZSTD'.")
    if isinstance(compression, bool) or not isinstance(compression, (int, float)) or not 0 <= compression <= 100:
        raise ValueError("Parameter compression should be a numeric value in the range 0 to 100")
    codec, level = CODECS[compressor], int(compression)
    _bound_batches()

    @F.arrow_udf("binary")
    def body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = _codec(compressor, level)

        def one(value):
            size = block_size(len(value))
            blocks = [tool.compress(value[i : i + size], asbytes=True) for i in range(0, len(value), size)]
            head = bytes([codec, int(hash)]) + len(value).to_bytes(8, "big") + len(blocks).to_bytes(4, "big")
            return head + b"".join(len(b).to_bytes(4, "big") for b in blocks) + b"".join(blocks)

        yield from _in_pieces(batches, one)

    raw = _col(x).cast("binary")
    raw = F.when(F.length(raw) == 0, F.raise_error(F.lit("Source contains no data.")).cast("binary")).otherwise(raw)
    made = F.transform(F.array(body(raw)), _sealed)  # the codec's output is named once and used four times
    return F.get(made, 0)


def _sealed(made: Column) -> Column:
    head = made.substr(F.lit(1), _head_length(made, 11))
    payload = made.substr(_head_length(made, 11) + 1, F.length(made))
    inner = F.concat(_hash_bytes(payload), head)
    return F.concat(F.lit(bytes(MARKER)), _hash_bytes(inner), _hash_bytes(payload), made)


def _head_length(made: Column, at: int) -> Column:
    """Bytes of the head (codec, flag, lengths) whose number of blocks stands at byte ``at``."""
    return (F.lit(at + 3) + 4 * _number(made.substr(at, 4))).cast("int")


def _faults(x: Column) -> tuple[Column, Column]:
    """Whether the header of a compressed value is damaged, and whether its payload is."""
    blocks = _number(x.substr(31, 4))
    head_end = (F.lit(34) + 4 * blocks).cast("int")
    short = (F.length(x) < 35) | (x.substr(1, 4) != F.lit(bytes(MARKER)))
    head = short | (blocks > 1_000_000) | (F.length(x) <= head_end) | (
        F.hex(_hash_bytes(x.substr(F.lit(13), head_end - 12))) != F.hex(x.substr(5, 8))
    )
    return head, F.hex(_hash_bytes(x.substr(head_end + 1, F.length(x)))) != F.hex(x.substr(13, 8))


def is_damaged(x: Column | str) -> Column:
    """Whether a compressed value would not decompress; null for null."""
    raw = _col(x).cast("binary")
    head, payload = _faults(raw)
    return F.when(raw.isNotNull(), head | payload)


def _checked(x: Column) -> Column:
    """The value if its header and payload are whole; an error otherwise."""
    bad_head = F.lit("Incorrect header information found")
    broken_head, broken = _faults(x)
    message = F.when(x.substr(22, 1) == F.lit(b"\x01"), F.lit("Incorrect input vector")).otherwise(
        F.lit("An error was detected in the compressed data stream")
    )
    return (
        F.when(broken_head, F.raise_error(bad_head).cast("binary"))
        .when(broken, F.raise_error(message).cast("binary"))
        .otherwise(x)
    )


def decompress(x: Column | str) -> Column:
    """The raw value of a compressed one; null stays null, a damaged value is an error."""
    _bound_batches()

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tools = {1: pa.Codec("lz4_raw"), 2: pa.Codec("zstd")}

        def one(value):
            tool, size = tools[value[20]], int.from_bytes(value[22:30], "big")
            n = int.from_bytes(value[30:34], "big")
            at, step, out = 34 + 4 * n, block_size(size), []
            for i in range(n):
                length = int.from_bytes(value[34 + 4 * i : 38 + 4 * i], "big")
                out.append(tool.decompress(value[at : at + length], min(step, size - i * step), asbytes=True))
                at += length
            return b"".join(out)

        yield from _in_pieces(batches, one)

    return raw(_checked(_col(x).cast("binary")))


def hash_blob(x: Column | str, seed: int | None = None, block_hash: bool = True) -> Column:
    """A 64-bit hash as bigint; null stays null.

    The flat hash of the default seed is xxHash64 with seed 42; other seeds give another family.
    With ``block_hash`` a value of more than one block is hashed block by block.
    """
    if seed is not None and (isinstance(seed, bool) or not isinstance(seed, int)):
        raise ValueError("Please specify an integer value for the hash seed.")
    if not isinstance(block_hash, bool):
        raise ValueError("Please specify a logical value for parameter block_hash.")
    raw = _col(x).cast("binary")

    def flat(c: Column) -> Column:
        return F.xxhash64(c) if seed is None else F.xxhash64(F.lit(seed).cast("long"), c)

    if not block_hash:
        return F.when(raw.isNotNull(), flat(raw))
    starts = F.sequence(F.lit(0), F.expr("0") + ((F.length(raw) - 1) / BLOCK_BYTES).cast("int"))
    parts = F.transform(starts, lambda i: flat(raw.substr(i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES))))
    first = F.lit(HASH_SEED if seed is None else seed).cast("long")
    folded = F.aggregate(parts, first, lambda acc, h: F.xxhash64(acc, h))
    return F.when(F.length(raw) <= BLOCK_BYTES, flat(raw)).when(raw.isNotNull(), folded)
