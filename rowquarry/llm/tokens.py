"""Token counts by a map-side two-tier lookup (operator 1).

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a cache in each
worker that encodes what the table misses. No pre-token is ever shuffled: the table comes from
bounded per-task summaries of all documents that are merged pairwise; it affects speed alone.

The pre-tokens are cut by a regular expression: a fast one for texts of Latin letters, digits and
punctuation, one of Unicode classes for all others. Both agree with the library on every character
that Unicode 15.1 assigns; a text with an unassigned one, whose class differs from one edition of
Unicode to the next, is encoded by the library as a whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows, ties and repeats keep their
own result row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, merged, one_thread, slices, texts

LIMIT = 1024
#: Entries of the broadcast table, and of each summary.
TABLE = 16_384
#: Entries of a worker's cache beyond the table before it is emptied.
CACHE = 300_000
#: Characters of a text that are cut into pre-tokens at once.
SPAN = 1 << 20

_LATIN = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F] + [chr(c) for c in range(0x2010, 0x2028)] + ["€"]
_SPACE = [c for c in _LATIN if c in "\t\n\v\f\r \x85\xa0"]
_LETTER = [c for c in _LATIN if unicodedata.category(c)[0] == "L"]
_NUMBER = [c for c in _LATIN if unicodedata.category(c)[0] == "N"]


def _class(chars: list[str]) -> str:
    """The characters as ranges of a regular expression's class."""
    out, codes = "", sorted(map(ord, chars))
    while codes:
        n = 1
        while n < len(codes) and codes[n] == codes[0] + n:
            n += 1
        out += f"\\u{codes[0]:04x}-\\u{codes[n - 1]:04x}"
        codes = codes[n:]
    return out


_L, _N, _S = _class(_LETTER), _class(_NUMBER), _class(_SPACE)
SLOW = re.compile(f"[^{_class(_LATIN)}]")
PRETOKEN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
ANY_PRETOKEN = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Between a letter and a space with a letter after it, pre-tokens always part.
SEAM = re.compile("(?<=[a-z])(?= [a-z])")


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """The text in stretches that end where pre-tokens part; one stretch if there is no such place."""
    at = 0
    while len(text) - at > size:
        seam = SEAM.search(text, at + size)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


@lru_cache(1 << 16)
def _unassigned(char: str) -> bool:
    return unicodedata.category(char) == "Cn"


def cutter(text: str):
    """What cuts the text into pre-tokens; None if a character of it has no class that all editions of Unicode agree on."""
    if not SLOW.search(text):
        return PRETOKEN.findall
    return None if any(map(_unassigned, set(text))) else ANY_PRETOKEN.findall


def _pruned(counts: Counter, size: int) -> Counter:
    return Counter(dict(counts.most_common(size)))


def _pack(counts: Counter) -> bytes:
    return zlib.compress(json.dumps(counts, ensure_ascii=False).encode())


def _merge(payloads: list[bytes]) -> bytes:
    total: Counter = Counter()
    for p in payloads:
        total.update(json.loads(zlib.decompress(p)))
        total = _pruned(total, 2 * TABLE) if len(total) > 4 * TABLE else total
    return _pack(_pruned(total, TABLE))


def frequent_pretokens(docs: DataFrame, special: list[str], size: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of all documents, from summaries of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches):
            for text in texts(b, "text"):
                if not (cut := cutter(text)):
                    continue
                for part in spans(text):
                    counts.update(cut(part))
                    if len(counts) > 8 * size:
                        counts = _pruned(counts, size)
        if counts:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([_pack(_pruned(counts, size))], pa.binary())],
                ["part", "payload"],
            )

    parts = docs.select("text").mapInArrow(run, "part int, payload binary")
    total = json.loads(zlib.decompress(_merge(merged(parts, _merge))))
    return [t for t in total if t not in special]


class Lengths:
    """Token counts of whole texts, in one worker."""

    def __init__(self, path: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table, self.cache = table, dict(table)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def encode(self, missing: list[str]) -> None:
        """Put the lengths of the pre-tokens into the cache."""
        joined = [m for m in missing if not m.isspace()]
        spaces = [m for m in missing if m.isspace()]
        for m, e in zip(spaces, self.tokenizer.encode_batch(spaces, add_special_tokens=False), strict=True):
            self.cache[m] = len(e.ids)
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        # a line break before and between pre-tokens is a pre-token of its own
        for g, e in zip(
            groups, self.tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False), strict=True
        ):
            counts = Counter(e.word_ids)
            if len(counts) == 2 * len(g) - 1 and None not in counts:
                self.cache.update(zip(g, (counts[2 * i] for i in range(len(g))), strict=True))
            else:
                for m in g:
                    self.cache[m] = len(self.tokenizer.encode(m, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not (cut := cutter(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, at = 0, 0
        for hit in [*self.special.finditer(text), None]:
            total += self._plain(text[at : hit.start() if hit else len(text)], cut) + (hit is not None)
            at = hit.end() if hit else at
        return total

    def _plain(self, text: str, cut) -> int:
        total = 0
        for part in map(cut, spans(text)):
            if len(self.cache) > CACHE + len(self.table):
                self.cache = dict(self.table)
            lengths = list(map(self.cache.get, part))
            if None in lengths:
                self.encode(list({p for p, n in zip(part, lengths, strict=True) if n is None}))
                lengths = list(map(self.cache.__getitem__, part))
            total += sum(lengths)
        return total


_kept: dict[str, Lengths] = {}


def lengths_of(path: str, table: dict[str, int]) -> Lengths:
    """This process's counter for a tokenizer file; its cache outlives the task.

    Looked up by a function of the module: what a shipped closure names itself, it copies.
    """
    known = _kept.get(path)
    if known is None:
        known = _kept[path] = Lengths(path, table)
    elif known.table is not table:
        known.table, known.cache = table, known.cache | table
    return known


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the byte-level library file counts them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one_thread()
    driver = Lengths(tokenizer, {})
    words = frequent_pretokens(rows, special=[])
    for i in range(0, len(words), 4096):
        driver.encode(words[i : i + 4096])
    table = rows.sparkSession.sparkContext.broadcast({w: driver.cache[w] for w in words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        lengths = lengths_of(tokenizer, table.value)
        for b in slices(batches):
            n = [lengths.count(t) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = rows.withColumn("n_bytes", size).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")
