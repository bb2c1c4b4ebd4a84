"""Packing: ids as the tokenizer library gives them, an exact round trip, and few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowquarry.llm import packing
from rowquarry.llm.packing import op8_packing, pack, packed

from .test_tokens import characters

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def ids_of(tool, text):
    return [*tool.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity):
    """Every document is there whole, and every sequence is filled from 0 without gaps."""
    tool = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, text in texts.items():
        ids = ids_of(tool, text)
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // capacity)))
        for p in parts:
            assert p.start == p.piece * capacity and p.length == min(capacity, len(ids) - p.start)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert set(by_doc) == set(texts)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


EDGES = [
    None, "", " ", "Word. WORD, word; don't!", "İstanbul Straße ǅ é È", "a\x1cb c\x01d \x01", "東京 🙂", "<|startoftext|> a <|endoftext|>", "x" * 4000,
    "word " * 5000, "1 22 333", "...", "a.b,c.", "Ünïcode wörds. again,", "tab\tnew\nline\x0bvt\x0cff\x85nel\xa0nbsp", "'s 're I'LL", "word.. word.,", "é., É.",
]


@pytest.mark.parametrize("capacity", [2048, 100])
def test_edges(spark, capacity):
    df = spark.createDataFrame(list(enumerate(EDGES)), SCHEMA).withColumn("id", F.lit("clash")).withColumn("length", F.lit(1)).withColumn("task", F.lit(1))
    used, least = check(packed(df.repartition(3), PATH, capacity=capacity).collect(), dict(enumerate(EDGES)), capacity)
    assert used <= least + 2


def test_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op8_packing(spark, sf).withColumnRenamed("doc_id", "id").collect()
    used, least = check(rows, texts, 2048)
    assert used <= 1.05 * least + 1


def test_repeats_missing_ids_and_empty_tables(spark):
    assert packed(spark.createDataFrame([], SCHEMA), PATH).isEmpty()
    rows = packed(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SCHEMA), PATH).collect()
    assert sorted((r.id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert sorted((r.offset, r.length) for r in rows) in ([(0, 1), (1, 3), (4, 3)], [(0, 3), (3, 3), (6, 1)], [(0, 3), (3, 1), (4, 3)])


def test_plans_use_every_piece_once_and_fill_gaps():
    rng = np.random.default_rng(2)
    for n in (1, 10, 2000):
        lengths = np.minimum(1 + rng.lognormal(3.5, 1.2, n).astype(int), 256)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = pack(histogram, 256)
        used = {}
        for pattern, k in plan:
            assert sum(pattern) <= 256 and k > 0
            for x in pattern:
                used[x] = used.get(x, 0) + k
        assert used == histogram
        sequences = sum(k for _, k in plan)
        assert sequences <= 1.01 * -(-int(lengths.sum()) // 256) + 1
    assert pack({}, 256) == []


def test_all_scripts_and_stretches_as_the_library_gives_them(monkeypatch):
    r, pool, tool = random.Random(6), characters(), Tokenizer.from_file(PATH)
    encoder = packing.word_ids(PATH)
    assert packing.word_ids(PATH) is encoder
    texts = ["".join(r.choices(pool, k=r.randrange(1, 90))) for _ in range(1500)]
    for span, cache in ((packing.SPAN, packing.CACHE), (20, 50)):
        monkeypatch.setattr(packing, "SPAN", span)
        monkeypatch.setattr(encoder, "most", cache)
        monkeypatch.setattr(packing, "KEEP", min(cache, 10))
        for text, ids in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, ascii(text)


def test_pair_sums_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        have = np.zeros(101, np.int64)
        have[rng.integers(1, 101, 12)] = rng.integers(1, 6, 12)
        lengths = np.nonzero(have)[0]
        pairs = packing.PairSums(lengths, 100)
        have[rng.choice(lengths, 3)] = 0  # used up since
        for total in range(101):
            sums = {(int(a), int(b)) for a in lengths for b in lengths if a <= b and a + b == total and have[a] and have[b] and (a < b or have[a] > 1)}
            found = pairs.find(have, total)
            assert (found in sums) if sums else found is None
