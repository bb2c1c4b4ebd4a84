"""Planted benchmark passages are found, whole and paraphrased, and nothing else is."""

import random

import pytest
from pyspark.sql import functions as F

from rowquarry.llm.decontaminate import clean, common, contaminated, op10_decontamination, words

SYLLABLES = ["ba", "ko", "ri", "tem", "sul", "na", "vo", "pil", "dra", "gen", "lo", "mi"]


def lexicon(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    common_words = lexicon(1, 300)
    rare = lexicon(2, 3000)
    say = lambda n: [r.choice(common_words if r.random() < 0.6 else rare) for _ in range(n)]
    items = [(k, " ".join(say(r.randint(18, 60)))) for k in range(40)]
    docs, want = [], set()
    for i in range(300):
        text = say(r.randint(30, 900))
        if i % 10 == 0:
            k = r.randrange(40)
            passage = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: some words replaced, case and marks changed
                for at in r.sample(range(len(passage)), len(passage) // 9):
                    passage[at] = r.choice(rare)
                passage = [w.upper() + "," for w in passage]
            at = r.randrange(len(text))
            text[at:at] = passage
            want.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, items, want


def frames(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("item_id", F.lit("clash"))
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumn("answer", F.lit(None).cast("string"))


def test_planted_passages(spark, case):
    docs, items, want = case
    d, b = frames(spark, docs, items)
    got = {(r.id, r.item_id) for r in contaminated(d, b).collect()}
    assert got == want
    left = clean(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_the_table_holds_whole_items(spark, sf):
    items = {r.item_id: words(r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: b" " + b" ".join(words(r.text or "")) + b" " for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    exact = {(i, k) for i, t in docs.items() for k, w in items.items() if len(w) >= 5 and b" " + b" ".join(w) + b" " in t}
    rows = op10_decontamination(spark, sf).collect()
    assert exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        w = items[r.item_id]
        assert r.answer or common(w, docs[r.doc_id].split()) >= 0.8 * len(w)


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(30))] for _ in range(2))
        assert common(a, b) == slow(a, b)


def test_edges(spark, case):
    docs, items, _ = case
    odd_docs = [(None, items[0][1]), (1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (4, "word " * 200_000 + items[1][1]), (5, "short")]
    odd_items = [*items[:3], (50, None), (51, ""), (52, "four words only here"), (None, items[4][1])]
    d, b = frames(spark, odd_docs, odd_items)
    got = sorted(((r.id or 0), r.item_id) for r in contaminated(d, b).collect())
    assert got == [(0, 0), (3, 0), (3, 0), (4, 1)]
    assert sorted(r.doc_id for r in clean(d, b).collect()) == [1, 2, 5]
    for x, y in ((d.where("false"), b), (d, b.where("false")), (d.where("false"), b.where("false"))):
        assert contaminated(x, y).isEmpty() and clean(x, y).count() == x.count()


def changed(r, text, share, strange):
    """The words of ``text`` with a share of them replaced, evenly spread."""
    out, n = text.split(), round(len(text.split()) * share)
    for j in range(n):
        out[int((j + r.random()) * len(out) / n)] = r.choice(strange)
    return out


@pytest.mark.parametrize("share, least", [(0.2, 0.95), (0.25, 0.9), (0.3, 0.75)])
def test_paraphrases_of_items_without_an_answer(spark, case, share, least):
    docs, items, _ = case
    r, strange, clean_docs = random.Random(8), lexicon(9, 500), [t for i, t in docs if i % 10]
    made = []
    for k, text in items:
        other = r.choice(clean_docs).split()
        at = r.randrange(len(other))
        made.append((k, " ".join(other[:at] + changed(r, text, share, strange) + other[at:])))
    d, b = frames(spark, made + [(1000 + i, t) for i, t in enumerate(clean_docs)], items)
    got = {(x.id, x.item_id) for x in contaminated(d, b).collect()}
    assert got <= {(k, k) for k, _ in items} and len(got) >= least * len(items)


def test_paraphrases_with_a_short_answer(spark, case):
    _, items, _ = case
    r, strange = random.Random(8), lexicon(9, 500)
    made, told = [], []
    for k, text in items:
        words_ = changed(r, text, 0.25, strange)
        filler = [r.choice(strange) for _ in range(200)]
        made += [(2 * k, " ".join(filler + words_ + ["the", "answer:", "Paris", f"no{k}."] + filler))]
        made += [(2 * k + 1, " ".join(["Paris", f"no{k}."] + filler + words_ + filler))]  # far away
        told.append((k, text, f"Paris no{k}"))
    d = spark.createDataFrame(made, "doc_id long, text string")
    b = spark.createDataFrame(told, "item_id long, text string, answer string")
    got = {(x.id, x.item_id) for x in contaminated(d, b, answer_col="answer").collect()}
    weak = {i for i, t in made if common(words(items[i // 2][1]), words(t)) >= 0.8 * len(words(items[i // 2][1]))}
    assert {i for i, _ in got if i % 2} <= weak and len({i for i, _ in got if i % 2 == 0}) >= 0.9 * len(items)


def test_an_answer_at_one_place_holds_for_the_document():
    from rowquarry.llm import decontaminate

    items = decontaminate.Items([(1, " ".join(f"w{i}" for i in range(20)), "Paris")])
    items.rare = [[]]
    item, other = items.items[0], [b"x%d" % i for i in range(60)]
    one = item[:14] + other[:6] + [b"paris"]  # 0.70 with the answer beside it
    two = item[:15] + other[6:11]  # 0.75 without
    doc, hits = one + other * 3 + two, {}
    for at in (0, len(one) + len(other) * 3):
        decontaminate._check(items, doc, at, 0, 0, hits)
    assert hits == {(0, 0): (0.75, True)}


def test_short_items_are_phrases(spark):
    items = [(1, "Paris"), (2, "forty two"), (3, "one two three four"), (4, " "), (5, None)]
    docs = [(1, "in Paris, in spring"), (2, "forty; TWO of them"), (3, "forty one two three"), (4, "zero one two three four five"), (5, "parisian"), (6, None)]
    d, b = frames(spark, docs, items)
    assert sorted((r.id, r.item_id, r.lcs) for r in contaminated(d, b).collect()) == [(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0)]
    assert sorted(r.doc_id for r in clean(d, b).collect()) == [3, 5, 6]


def test_a_large_benchmark_is_searched_in_parts(spark, case, monkeypatch):
    from rowquarry.llm import decontaminate

    monkeypatch.setattr(decontaminate, "MOST_WORDS", 600)
    monkeypatch.setattr(decontaminate, "STEP", 8)
    docs, items, want = case
    d, b = frames(spark, docs, items)
    assert {(r.id, r.item_id) for r in contaminated(d, b).collect()} == want
    assert {r.doc_id for r in clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}
