"""Token counts against the tokenizer library, text by text."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowquarry.llm import tokens
from rowquarry.llm.tokens import op1_token_counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def library(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


EDGES = [
    None, "", " ", "\n\n  \t x", "a<|endoftext|>b", "<|endoftext|>" * 3, "I'll don't 's 'S x'ré", "naïve café №1 ½ ²", "東京 は 🙂🙂 x", "a\x00b\x1cc\x85d\xa0e f",
    "  two  spaces  ", "tab\tand\r\nbreak", "x" * 5000, "1234567890" * 50, "!?" * 40 + " end", "é" * 300, "Straße İstanbul ǅ", "a " * 3000, "​z‍",
]


def test_edges_as_the_library_counts_them(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), SCHEMA)
    df = df.withColumn("id", F.lit("clash")).withColumn("n_bytes", F.lit(7)).withColumn("n_tokens", F.lit(None))
    got = {r.id: r for r in token_counts(df, PATH, limit=100).collect()}
    for k, text in enumerate(EDGES):
        n = library(text)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 100), repr(text)[:60]


def test_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    tool = Tokenizer.from_file(PATH)
    got = op1_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tool.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 1024)


def test_long_texts_in_stretches_and_a_small_cache(spark, monkeypatch):
    text = "some words, and more; " * 2000 + "x" * 999
    counter = tokens.Lengths(PATH, {})
    whole = counter.count(text)
    monkeypatch.setattr(tokens, "SPAN", 500)
    monkeypatch.setattr(tokens, "CACHE", 3)
    assert list(tokens.spans(text, 500)) != [text] and "".join(tokens.spans(text, 500)) == text
    assert tokens.Lengths(PATH, {}).count(text) == whole == library(text)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "twice"), (1, "twice"), (None, "no id")]])
def test_empty_missing_and_repeated(spark, rows):
    got = token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sorted(r.n_tokens for r in got) == sorted(library(t) for _, t in rows)


def characters():
    """Of many scripts, marks, numbers, spaces and emoji, some that Unicode does not assign, and plain ones more often."""
    parts = [range(0x600), range(0x900, 0x980), range(0xE00, 0xE60), range(0x2000, 0x2100), range(0x3040, 0x30A0), range(0x4E00, 0x4E40), range(0x1F600, 0x1F640)]
    odd = [0x200D, 0xFE0F, 0x3000, 0x1680, 0x2028, 0x1D7D8, 0x378, 0x10FFFF, 0x1C89]
    return [chr(c) for part in parts for c in part] + [chr(c) for c in odd] * 5 + [" "] * 300 + list("abc'stre\n") * 30


def test_all_scripts_as_the_library_counts_them():
    r, pool, tool, counter = random.Random(4), characters(), Tokenizer.from_file(PATH), tokens.Lengths(PATH, {})
    for _ in range(2500):
        text = "".join(r.choices(pool, k=r.randrange(1, 60)))
        assert counter.count(text) == len(tool.encode(text, add_special_tokens=False).ids), ascii(text)


def test_only_unassigned_characters_leave_the_table():
    assert all(map(tokens.cutter, ["Привет, мир", "東京 は 🙂", "naïve", "สวัสดี", ""]))
    assert not tokens.cutter("a\u0378b") and not tokens.cutter("\U0010ffff")


def test_the_cache_outlives_a_task():
    one = tokens.lengths_of(PATH, {"a": 1})
    one.count("some words here")
    two = tokens.lengths_of(PATH, {"b": 1})
    assert one is two and {"a", "b", " words"} <= two.cache.keys()
