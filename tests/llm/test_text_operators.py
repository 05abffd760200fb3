"""Operators on single texts and rows against brute force, with nulls, empty and long texts, ties and odd columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import chat, languages, packing, private_data, quality, sharding, token_files, toxicity
from fleetgauge.llm.queries import conversation_records, vocabulary
from fleetgauge.llm.vocabulary import Encoder

LONG = "word, " * 3000 + "the end."
TEXTS = [(3, "One text, twice."), (1, "One text, twice."), (1, "One text, twice."), (2, None), (4, ""), (5, LONG), (None, "No key."),
         (6, "çé 你好  tabs\there\nand\xa0there <|endoftext|> it's 1,234.5"), (7, " \n\t ")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    """Odd rows, with columns that clash with those of the operators."""
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns({
        "lang": F.lit(None).cast("string"), "score": F.lit("mine"), "spans": F.lit(1), "shard": F.lit("x"), "row_key": F.lit(0),
        "start": F.lit(9), "file": F.lit("f"), "id": F.lit(None).cast("long")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


def test_encoder_is_the_library(spark):
    from tokenizers import Tokenizer
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "'s", "'t", "9", "12", ".", ",", "\xa0", "“", "你", "é", "İ", "σς", "<|endoftext|>",
             "_", "-", "\x1c", "\x00", "#", "²", "　", "\r\n", "\x85", "word", "Ünïcode"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for name, lower in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        plain, own = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name), lower)
        for text in texts:
            assert np.frombuffer(own.ids(text.encode()), own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n, 3)
    assert sorted(places.tolist()) == list(range(n))
    assert sharding.permute(places, n, 3, back=True).tolist() == list(range(n))
    shard, slot = sharding.place(rows, n, 4, 3)
    assert all(sharding.row_at(int(a), int(b), n, 4, 3) == i for i, (a, b) in enumerate(zip(shard, slot)))


def test_shards(spark, documents, nothing, tmp_path):
    rows = sharding.assign_shards(documents, 4).collect()
    assert sorted(r.row_number for r in rows) == list(range(len(TEXTS)))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in TEXTS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter(map(tuple, rows)) == Counter(map(tuple, sharding.assign_shards(documents.repartition(5), 4).collect()))
    assert sharding.assign_shards(nothing, 4).count() == 0
    written = sharding.write_shards(documents.select("doc_id", "text"), str(tmp_path / "shards"), 4)
    assert Counter((r.doc_id, r.text) for r in written.collect()) == Counter(TEXTS)


def test_token_files(spark, documents, nothing):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    manifest = token_files.write_token_files(documents, vocabulary("word_bpe_49k.json"), 1, True, length=64)
    rows = sorted(token_files.read_back(manifest).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(rows) == len(TEXTS)
    expected = Counter()
    for key, text in TEXTS:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        expected[key, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    one = manifest.orderBy(F.desc("n_tokens")).first()
    reader = token_files.Reader(one.file)
    ids, mask = reader.sequence(one.start // 64)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and mask.all()
    assert ids[one.start % 64:].tolist() == reader.ids(one.start, 64 - one.start % 64).tolist()
    reader.close()
    assert token_files.write_token_files(nothing, vocabulary("word_bpe_49k.json"), 1, True).count() == 0


def test_token_file_padding(tmp_path):
    writer = token_files.Writer(str(tmp_path / "a" / "x.arrow"), 2, 8)
    numbers = np.arange(8 * token_files.BATCH + 13, dtype="<u2")
    for part in np.array_split(numbers, 7):
        writer.add(part.tobytes())
    writer.close()
    reader = token_files.Reader(str(tmp_path / "a" / "x.arrow"))
    assert reader.ids(0, len(numbers)).tolist() == numbers.tolist()
    ids, mask = reader.sequence(token_files.BATCH + 1)
    assert ids.tolist()[:5] == numbers[-5:].tolist() and mask.tolist() == [True] * 5 + [False] * 3


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng, window = np.random.default_rng(seed), 64
    counts = np.bincount(rng.integers(1, window + 1, 500 * seed), minlength=window + 1)
    made = packing.plan(counts, window)
    used = Counter()
    for lengths, n in made:
        assert n > 0 and sum(lengths) <= window
        for a in lengths:
            used[a] += n
    assert used == Counter({a: int(n) for a, n in enumerate(counts) if n})
    if seed == 3:
        total = sum(a * n for a, n in enumerate(counts.tolist()))
        assert total / (window * sum(n for _, n in made)) > 0.97


def test_packing(spark, documents, nothing):
    from tokenizers import Tokenizer
    plain, window = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 128
    rows = packing.pack(documents, vocabulary("byte_bpe_50k.json"), 0, window).collect()
    whole = Counter((key, tuple(plain.encode(text or "", add_special_tokens=False).ids + [0])) for key, text in TEXTS)
    pieces = Counter((r.doc_id, r.start, r.doc_tokens, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in rows)
    expected = Counter()
    for (key, ids), times in whole.items():
        for at in range(0, len(ids), window):
            expected[key, at, len(ids), ids[at:at + window]] += times
    assert pieces == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= window
    assert packing.pack(nothing, vocabulary("byte_bpe_50k.json"), 0).count() == 0


def naive_repeats(words, window=8):
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    covered = {j for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1 for j in range(i, i + window)}
    return len(covered)


def test_quality(spark, documents, nothing):
    rng = random.Random(2)
    texts = TEXTS + [(100 + i, "\n".join(" ".join(rng.choice("ab c# d") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    frame = spark.createDataFrame(texts, SCHEMA).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x"))
    got = Counter()
    for r in quality.judge(frame, vocabulary("piece_bpe_32k.model")).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] += 1
        assert not (r.base_failed and r.kept) and r.kept is not None
    expected = Counter()
    for key, text in texts:
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = naive_repeats(words)
        expected[key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats,
                 len(words) < 20 or 100 * repeats > 30 * len(words)] += 1
    assert got == expected
    assert quality.judge(nothing, vocabulary("piece_bpe_32k.model")).count() == 0
    assert [quality.script_of(t) for t in ("abc", "где ты", "你好", "12", "ሀሁ")] == ["latin", "cyrillic", "han", "none", "other"]


def test_languages(spark, documents, nothing):
    rng = random.Random(1)
    syllables = {"x": ["ka", "to", "ri"], "y": ["schw", "end", "ung"], "z": ["çé", "eau", "oi"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    model = languages.train(spark.createDataFrame([(say(x, 200), x) for x in "xyz" for _ in range(4)] + [(None, "x"), ("text", None)], "text string, lang string"))
    assert model.languages == ["x", "y", "z"]
    texts = [(0, say("x", 60)), (1, say("y", 90) + " " + say("z", 30)), (2, "12 34"), (3, None), (4, ""), (5, say("z", 1))]
    rows = {r.doc_id: r for r in languages.predict(spark.createDataFrame(texts, SCHEMA), model).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["x", "y", "und", "und", "und", "z"]
    assert abs(rows[1].mixture["y"] - 0.75) < 0.08 and set(rows[1].mixture) == {"y", "z"} and set(rows[0].mixture) == {"x"}
    assert languages.predict(documents, model).count() == len(TEXTS) and languages.predict(nothing, model).count() == 0
    none = languages.train(nothing)
    assert {r.lang_pred for r in languages.predict(documents, none).collect()} == {"und"}


def test_toxicity(spark, documents, nothing):
    rng = random.Random(4)
    syllables = ["an", "er", "on", "th", "re", "ti", "es", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grubbly", "snarkwit", "zoggish"]
    rows, marks = [], []
    for i in range(400):
        text, toxic = [word() for _ in range(rng.randint(5, 200))], i % 4 == 0
        for _ in range(2 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    frame = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(frame.filter("doc_id < 300"), spark.createDataFrame(marks + [(None, 1), (3, 7), (99999, 1)], "doc_id long, toxic int"))
    scored = {r.doc_id: r for r in toxicity.classify(frame.withColumn("toxic_score", F.lit("old")), model).collect()}
    assert sum(scored[i].toxic_predicted == (i % 4 == 0) for i in range(300, 400)) >= 97
    assert toxicity.classify(documents, model).count() == len(TEXTS)
    by_text = defaultdict(set)
    for r in toxicity.classify(documents, model).collect():
        assert 0 <= r.toxic_score <= 1
        by_text[r.text].add(r.toxic_score)
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""]
    assert toxicity.classify(nothing, model).count() == 0
    constant = toxicity.train(frame, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r.toxic_predicted for r in toxicity.classify(frame, constant).collect()} == {0}


def test_chats_of_any_length(spark):
    """A turn beyond the limit of JSON readers, and texts that look like field names, escapes and ends of strings."""
    odd = ['say "role": \\"x\\": {', "\\\\", 'ends in \\', '"', '": [', "\n\t{}"]
    turns = spark.createDataFrame([(i, k, role, text) for i, text in enumerate(odd) for k, role in enumerate(("user", "assistant", "user"))], "conv_id long, turn long, role string, text string")
    long = spark.range(1).select(F.lit(99).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"),
                                 F.repeat(F.lit('word "q" \\ \n'), 1_750_000).alias("text"))
    more = long.withColumns({"turn": F.lit(1).cast("long"), "role": F.lit("assistant"), "text": F.lit("ok")})
    done = chat.format_chats(conversation_records(turns.unionByName(long).unionByName(more)))
    got = {r.conv_id: r for r in done.select("conv_id", "layout", F.transform(chat.read_turns(F.col("formatted")), lambda t: F.struct(
        t.role.alias("role"), F.length(t.text).alias("n"), F.md5(t.text.cast("binary")).alias("m"))).alias("turns")).collect()}
    for i, text in enumerate(odd):
        digest = hashlib.md5(text.encode()).hexdigest()
        assert got[i].layout != "unknown" and [tuple(t) for t in got[i].turns] == [(role, len(text), digest) for role in ("user", "assistant", "user")]
    assert got[99].layout == "prompt" and [(t.role, t.n) for t in got[99].turns] == [("user", 12 * 1_750_000), ("assistant", 2)]


def test_control_strings_go_round(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\l", "<|end|>", "\\\\<|", "a<|turn|>b|>", "<<SYS>>x<</SYS>>", "<", "<s", "[", "\\<s>\\\\", "|>", "\n", "çé你\x00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.col("text").alias("text")) for r in ("user", "assistant", "assistant")))
    done = rows.select("i", "text", chat.written(turns).alias("f"), chat.loss_spans(turns).alias("s"))
    for r in done.select("text", "f", chat.read_turns(F.col("f")).alias("t"), chat.loss_text(F.col("f"), F.col("s")).alias("loss")).collect():
        assert [(t.role, t.text) for t in r.t] == [("user", r.text), ("assistant", r.text), ("assistant", r.text)] and r.loss == 2 * r.text
        assert all(c not in r.f.replace("<|turn|>", "").replace("<|says|>", "").replace("<|end|>", "") for c in chat.CONTROL)


def test_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"human","content":null}]}': ("messages", [("user", "a"), ("human", "")]),
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"{\\"messages\\":1}"}]}': ("shared", [("user", "a"), ("assistant", '{"messages":1}')]),
        '{"response":"b","prompt":"[INST]"}': ("prompt", [("user", "[INST]"), ("assistant", "b")]),
        '{"instruction":"s","input":null,"output":"o"}': ("instruction", [("system", "s"), ("assistant", "o")]),
        '{"question":"q","answer":"a"}': ("question", [("user", "q"), ("assistant", "a")]),
        '{"prompt":"p","completion":"c"}': ("completion", [("user", "p"), ("assistant", "c")]),
        '{"prompt":"p"}': ("unknown", None), "[1]": ("unknown", None), "no json": ("unknown", None), None: ("unknown", None),
    }
    frame = spark.createDataFrame([(r,) for r in records], "record string").withColumn("turns", F.lit(1))
    for row in chat.canonical_turns(frame).collect():
        assert (row.layout, row.turns and [(t.role, t.text) for t in row.turns]) == records[row.record]
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, None, "x"),
            (None, 0, "user", "y"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "</s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(conversation_records(frame)).select("conv_id", "layout", chat.read_turns(F.col("formatted")).alias("t")).collect()
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in done} == {k: [x[1:] for x in sorted(v)] for k, v in by.items()}
    assert {r.conv_id: r.layout for r in done} == {1: "prompt", 2: "shared", 3: "messages", None: "messages", 4: "instruction"}


# --- personal data ---------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def naive_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    rng = random.Random(9)
    parts = ["a.b@c.d", "@", ".", "x@y.z_w@v.u", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567",
             "+", " ", "  ", "-", "12", "é", "你", "\n", "\x01", "\x02", "word", "%_", "4111111111111111", "00", "(", "1" * 25]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["9" * 30_000, "a" * 30_000, "a." * 9000 + "@b", "1 " * 9000, "x@" + "a." * 5000 + "b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = dict(rows.select("doc_id", private_data.spelled(private_data.base_spans(F.col("text")))).collect())
    for i, text in enumerate(texts):
        assert got[i] == naive_spans(text), text[:200]


def test_contexts_find_unseen_identifiers(spark, documents, nothing):
    rng = random.Random(3)
    rows = [(i, f"Some words here and call hotline: +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now") for i in range(40)]
    rows += [(50, "Please call hotline: 55-1234-X7 today"), (51, "the number 77-1234-X7 stands alone"), (52, None)]
    found = {r.doc_id: r for r in private_data.find(spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(0))).collect()}
    assert [(s.kind, rows[40][1][s.start:s.end]) for s in found[50].spans] == [("like_phone", "55-1234-X7")] and not found[50].base_spans
    assert not found[51].spans and not found[52].spans and all(len(found[i].spans) == 1 for i in range(40))
    hidden = spark.createDataFrame([found[50]], private_data.find(spark.createDataFrame(rows, SCHEMA)).schema).select(private_data.masked(F.col("text"), F.col("spans"))).first()[0]
    assert hidden == "Please call hotline: <like_phone> today"
    assert Counter((r.doc_id, r.text) for r in private_data.find(documents).collect()) == Counter(TEXTS)
    assert private_data.find(nothing).count() == 0


def test_words_chosen_in_arrays_are_those_cut_one_by_one(spark):
    rng = random.Random(12)
    parts = ["word", "Two", "x9", "12", "é", "(a)", "+", "-", "...", "a-b", "\"q\"", ",", "(", ")", "(-", "-)", "ß.", "你好,", "\x04", "a..", "--b"]
    gaps = [" ", " ", " ", "  ", "\t", "\n", "\n \n", "\r\n", " \n", "\x0b"]
    texts = ["w" + "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 25))) + rng.choice(["", "end.", "."]) for _ in range(400)]
    texts += ["w " + "-" * 20000 + "x " + "." * 20000 + " y", "w", "w ", "w" + " \n" * 5000 + "x1"]
    frame = spark.createDataFrame([(t,) for t in texts], "marked string")
    every = private_data.instances(frame).select(F.explode("patterns").alias("pattern"), "value").distinct()
    table = private_data._bit_table(every)
    assert set(map(tuple, private_data.standing(frame, table, table).distinct().collect())) == set(map(tuple, every.collect()))
    none = private_data._bit_table(every.limit(0))
    for asked in (none, None):
        assert set(map(tuple, private_data.standing(frame, none, asked).distinct().collect())) == set(map(tuple, every.filter("value RLIKE '[0-9]'").collect()))


def test_contexts_of_seeds_without_digits(spark):
    """Addresses without a digit are seeds too; words without a digit are found where their pattern stands, and only there."""
    names = ["".join(p) for p in itertools.product("abcdef", "ghijkl")]
    rows = [(i, f"Text of some kind\nplease write to mailbox: {n}ne@{n}.example, thanks") for i, n in enumerate(names)]
    rows += [(100, "you can write to mailbox: alice(at)example or wait"), (101, "alice(at)example is no context"), (102, "thanks for some text"),
             (103, "you  write to mailbox: bob"), (104, "bob was here")]
    found = {r.doc_id: r for r in private_data.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {k: [(s.kind, rows[36 + k - 100][1][s.start:s.end]) for s in found[k].spans] for k in range(100, 105)}
    assert got == {100: [("like_email", "alice(at)example")], 101: [], 102: [], 103: [("like_email", "bob")], 104: []}
    assert all([s.kind for s in found[i].spans] == ["email"] for i in range(36))


def test_held_out_fold(spark):
    from fleetgauge.llm.common import held_out
    rows = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows.select("doc_id", held_out(F.col("doc_id"))).collect())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
