"""Operators that compare documents, and the pipeline, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import difference, duck
from conftest import SMALL
from pyspark.sql import functions as F

from fleetgauge.llm import decontamination, jaccard
from fleetgauge.llm.components import components
from fleetgauge.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def naive_components(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(texts):
        least[root(i)].append(key)
    first = {r: min((k for k in keys if k is not None), default=None) for r, keys in least.items()}
    return Counter((key, len(sets[i]), first[root(i)]) for i, (key, _) in enumerate(texts))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        what = rng.random()
        if what < 0.6:
            words[at] = f"w{rng.randrange(10**6)}"
        elif what < 0.8:
            words.insert(at, f"w{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_of_edited_copies(spark, seed):
    """Groups of copies with few and many edits, short sets and long ones, passages that many texts share."""
    rng, texts, key = random.Random(seed), [], 0
    passage = [f"p{i}" for i in range(30)]
    for group in range(14):
        base = [f"g{rng.randrange(400)}" for _ in range(rng.choice((3, 5, 6, 8, 12, 30, 60, 90, 200)))]
        if group % 3 == 0:
            base = passage + base
        for _ in range(rng.choice((1, 2, 25))):
            texts.append((key, rng.choice((" ", "\n", "\t ")).join(edited(rng, base, rng.randrange(5)))))
            key += rng.randint(1, 3)
    texts += [(key + 1, None), (key + 2, ""), (key + 3, " \n "), (None, texts[0][1]), (texts[3][0], texts[3][1].upper()), texts[5], texts[5], (None, "alone here")]
    rng.shuffle(texts)
    frame = spark.createDataFrame(texts, SCHEMA).withColumns({"id": F.lit("x"), "row_key": F.lit(1), "n": F.lit(2), "component_id": F.lit(3)}).repartition(4)
    found = jaccard.near_duplicates(frame).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == naive_components(texts)


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(4, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (2, " ".join(words[:-1] + ["x"])), (7, "other words that stand quite alone"), (8, None), (9, ""), (9, "")]
    frame = spark.createDataFrame(texts, SCHEMA).withColumn("leader", F.lit("mine"))
    kept = jaccard.deduplicated(frame)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([texts[1], texts[3], *texts[4:]])
    assert jaccard.deduplicated(frame.limit(0)).count() == 0


def test_split_buckets_and_chunk_borders(spark, monkeypatch):
    """Frequent keys cut into slices, batches of a few rows: the same buckets."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(80)]
    texts = [(i, " ".join(edited(rng, base, 2))) for i in range(120)]
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = jaccard.near_duplicates(spark.createDataFrame(texts, SCHEMA).repartition(2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == naive_components(texts)


def test_prefix_bounds():
    for n in range(1, 200):
        for m in range(n, 300):
            least = next((k for k in range(n + 1) if 100 * k >= 75 * (n + m - k)), None)
            if least is not None:
                assert least >= max(jaccard.least_overlap(n), jaccard.least_overlap(m))
                assert least == -(-75 * (n + m) // 175)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7), (500, 501), (501, 500)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "If Anna buys 12 apples at 3 dollars each and Boris buys 7 pears how much does Anna pay in total after 5 days"
ASKED = "If Clara buys 40 apples at 9 dollars each and David buys 8 pears how much does Clara pay in total after 2 days"
MIXED = "If Clara buys 40 apples at 9 dollars each and David buys 8 pears how much does Emil pay in total after 2 days"


def test_decontamination(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "what is the capital city of some small country"), (3, None), (4, ""), (5, "two words"),
                                       (6, "three short words")], "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(300))
    texts = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {ASKED}. {filler}"), (3, filler), (4, None), (5, ""), (None, f"he said: {ITEM}"),
             (7, "so WHAT IS THE CAPITAL CITY OF SOME SMALL COUNTRY?"), (8, "If Anna buys 12 apples she smiles"), (9, "x three short words y"), (9, "x three short words y"),
             (10, "12 13 14 15 16 17 18 19 20 21 22 23 24")]
    frame = spark.createDataFrame(texts, SCHEMA).withColumns({"row_key": F.lit("k"), "item_id": F.lit(9), "hash": F.lit(0)})
    found = {(r.doc_id, r.item_id, r.kind) for r in decontamination.contaminated(frame, benchmark).collect()}
    assert found == {(1, 1, "exact"), (2, 1, "reparameterised"), (None, 1, "exact"), (7, 2, "exact"), (9, 6, "exact")}
    kept = decontamination.decontaminated(frame, benchmark)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 8, 10}
    assert decontamination.contaminated(frame.limit(0), benchmark).count() == 0
    assert decontamination.contaminated(frame, benchmark.limit(0)).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = spark.createDataFrame([(1, MIXED), (2, ASKED)], SCHEMA)
    assert {r.doc_id for r in decontamination.contaminated(rows, benchmark).collect()} == {2}


def passage(n, seed=0):
    return [f"p{seed}word{i}x" for i in range(n)]


def found_in(spark, items, texts):
    """(doc_id, item_id, kind) of all pairs."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {(r.doc_id, r.item_id, r.kind) for r in decontamination.contaminated(rows, benchmark).collect()}


def test_copies_with_inserted_and_deleted_words_are_found(spark):
    """Windows are summed over the shifts of one stretch, not over the whole document; 13 equal words are enough."""
    filler = passage(300, 9)
    texts = []
    for n, edits in ((20, 1), (37, 2), (59, 3)):
        words = passage(n, n)
        for i in range(edits, 0, -1):
            words.insert(i * n // (edits + 1), "inserted")
        texts.append(" ".join(filler + words + filler))
    long = passage(59, 59)
    texts.append(" ".join(filler + [w for i, w in enumerate(long) if i % 12 != 9] + filler))
    texts.append(" ".join(filler + long[20:33] + filler))
    texts.append(" ".join(filler + long[20:32] + filler))
    texts.append(" ".join(sum((long[i:i + 9] + filler for i in range(0, 59, 9)), [])))
    items = [" ".join(passage(n, n)) for n in (20, 37, 59)]
    assert found_in(spark, items, texts) == {(0, 0, "exact"), (1, 1, "exact"), (2, 2, "exact"), (3, 2, "exact"), (4, 2, "exact")}


def test_a_clash_costs_its_windows_only(spark):
    words = passage(59)
    words[15] = words[40] = "12"
    copy = list(words)
    copy[40] = "13"
    both = ITEM.replace("12", "5").replace("5 days", "8 days")
    texts = [" ".join(copy), both.replace("7", "9").replace("3 ", "9 "), both.replace("Anna", "Clara").replace("7 pears", "5 pears"), MIXED]
    assert found_in(spark, [" ".join(words), ITEM], texts) == {(0, 0, "exact"), (1, 1, "reparameterised"), (2, 1, "reparameterised")}


def test_copies_are_found_whatever_their_words_and_capitals(spark):
    named = " ".join(f"Name{i}a calls p{i}q" if i % 2 else f"Name{i}b sees" for i in range(20))
    items = ["Complete the sequence: 1 4 9 16 25 36 49 64", "What is the capital of France?", named, "ribosome translocation", "7 8 9"]
    filler = passage(40, 9)
    texts = [" ".join([*filler, items[0], *filler]), "# Geography\nWhat is the capital of France? It is Paris", named.lower(), named.upper(),
             "Sum of ribosome translocation here", "6 7 8 9 10", "# Geography\nWhat is the capital of Spain? It is Madrid",
             "they asked: what is the capital of Italy? it is", "1 4 9 17 25 36 49 65", "the ribosome and translocation"]
    assert found_in(spark, items, texts) == {
        (0, 0, "exact"), (1, 1, "exact"), (2, 2, "exact"), (3, 2, "exact"), (4, 3, "exact"), (5, 4, "exact"),
        (6, 1, "reparameterised"), (7, 1, "reparameterised")}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert difference(duck(SMALL), ORACLE[name], QUERIES[name](spark, SMALL)) is None


def test_whole_items_in_documents_are_found(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_template_decontamination"](spark, SMALL).collect()}
    documents, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    held = {(int(d), int(b)) for d, t in zip(documents.doc_id, documents.text) for b, x in zip(benchmark.item_id, benchmark.text) if x in t}
    assert held <= found


def test_languages_held_out(spark):
    rows = QUERIES["op1_language_mixture"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out").toPandas()
    assert np.mean(held.lang == held.lang_pred) > 0.95


def test_pipeline(spark):
    """Each stage against what its decisions must be; the rows of the last against the texts that reach it."""
    import corpus_pipeline
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "benchmark", "private_data", "packing"]
    copies = corpus_pipeline.STAGES[1][1](spark, documents, SMALL)
    assert copies.columns == documents.columns
    expected = naive_components([(r.doc_id, r.text) for r in documents.collect()])
    assert {r.doc_id for r in copies.collect()} == {key for key, _, first in expected if key == first}
    masked = corpus_pipeline.STAGES[3][1](spark, documents, SMALL)
    assert masked.columns == documents.columns and masked.count() == documents.count()
    assert masked.filter(F.length("text") != F.col("n_chars")).isEmpty() and masked.filter(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]")).isEmpty()
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
