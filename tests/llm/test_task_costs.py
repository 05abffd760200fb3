"""What tasks must not do word by word or line by line, where no Python may run, and what memory is given back."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgauge.llm import jaccard, private_data


def test_short_words_are_hashed_together(monkeypatch):
    one_by_one = []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda word: one_by_one.append(bytes(word)) or 7)
    sets = jaccard.shingle_sets([b"A b\x0bC\td e\x00 e f", b"", b"a B c d e\x00  e F\n", b"x" * 65 + b" y", b"a b"])
    assert one_by_one == [b"x" * 65] and [len(s) for s in sets] == [3, 0, 3, 1, 1] and np.array_equal(sets[0], sets[2])
    words = [b"b", b"a\x00", b"a", b"12345678", b"123456781", b"123456789", b"z" * 64, b"z" * 63, b"\xff\xfe", b"\xc3\x84"]
    starts, hashes = jaccard.word_hashes(b" ".join(words))
    assert len(set(hashes.tolist())) == len(words) and starts.tolist() == [sum(map(len, words[:i])) + i for i in range(len(words))]


def test_lines_are_cut_in_whole_texts(spark):
    texts = ["  (Call) me, at: 5!\n--  hello \r\n\n((\na -(( \n--( b", "one\x01ip\x01192.0.2.1\x02 two"]
    frame = spark.createDataFrame([(t,) for t in texts], "marked string")
    cut = private_data.cut_lines(frame)
    assert [r.words for r in cut.collect()] == ["(call)\x01me\x01at\x015\n\x01hello\n\n\na\x01\n\x01b"]
    table = private_data._bit_table(spark.createDataFrame([("a",), ("me",)], "w string").select(F.xxhash64(F.lit(1), "w").alias("pattern")))
    rows = lambda given: sorted(map(tuple, private_data.standing(given, table, table).collect()))
    assert rows(cut) == rows(frame) and {v for _, v in rows(cut)} == {"at", "5"}


def test_masking_runs_no_python_in_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "mail to a@b.org now", 19), (2, None, 0)], "doc_id long, text string, n_chars long")

    def refused(*_):
        raise AssertionError("Python in tasks")
    monkeypatch.setattr(type(docs), "mapInArrow", refused)
    got = {r.doc_id: r.text for r in corpus_pipeline.without_private_data(spark, docs, "").collect()}
    assert got == {1: "mail to <email> now", 2: None}


def test_emptied_workers_give_their_memory_back():
    """What lies above the cache in the heap keeps an allocator from giving it back by itself."""
    script = """if True:
        from fleetgauge.llm import common
        held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
        before, words, above = held(), [], []
        common.kept("words", lambda: words)
        for i in range(200_000):
            words.append(b"%600d" % i)
        above += [b"%600d" % i for i in range(100)]
        full = held()
        del words
        common._empty()
        print(full - before, held() - before)
    """
    said = subprocess.run([sys.executable, "-c", script], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120, check=True)
    full, left = map(int, said.stdout.split())
    assert full > 100 and left < 20


def test_stages_begin_with_collected_heaps(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(corpus_pipeline, "let_go_of_shuffles", lambda spark: None)  # collects the driver's, here the same
    docs, before = spark.createDataFrame([(1, "a")], "doc_id long, text string"), collected()
    assert corpus_pipeline.rested(lambda spark, docs, folder: docs)(spark, docs, "").count() == 1
    assert collected() - before >= 1
