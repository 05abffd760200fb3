"""Personal data: fixed patterns, and bootstrapped contextual extraction on top. DataFrame functions only.

Seeds are what the fixed patterns find. The words around a seed are a lexical pattern; a pattern is as good as the share
of seeds among the identifiers it stands at, and an identifier (a word that no fixed pattern has found: any word with a
digit, and every word at a pattern that seeds support) is as good as the patterns it stands at. Patterns and instances are
scored in turns over the whole corpus; identifiers that end above the threshold join the seeds of the next turn and are
reported as spans of their own, those without a digit only where a trusted pattern stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, in_table, staged

#: The kinds in the order in which spans with one start are listed.
BASE = ("email", "ip", "card", "phone")
LEARNED = tuple(f"like_{kind}" for kind in BASE)
KINDS = BASE + LEARNED

ROUNDS = 3
#: Different seeds that a pattern needs, and the least score of patterns and of instances.
SUPPORT, CONFIDENCE = 3, 0.6

#: The fixed patterns. No match begins inside a run that the pattern's first part has failed on, and repeats are
#: possessive: so time is linear and the stack flat on long runs, and matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

_SPAN = "struct<kind:string,start:int,end:int,value:string>"
_MARK = "\x01"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the checksum."""
    points = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # As text, since a part may have any number of digits.
        number = lambda part: F.regexp_replace(part, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.lpad(number(p), 3, "0") <= "255"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans of a kind: leftmost matches that do not overlap, of which those that fail the kind's test are dropped.

    Matches are put between marks and the text is cut at them: parts at odd places are matches, and the lengths before
    them are their offsets in code points.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    found = F.aggregate(parts, start, lambda a, p: F.struct(
        (a.at + F.length(p)).alias("at"), (~a.odd).alias("odd"),
        F.when(a.odd, F.concat(a.spans, F.array(F.struct(
            F.lit(kind).alias("kind"), a.at.alias("start"), (a.at + F.length(p)).alias("end"), p.alias("value"))))).otherwise(a.spans).alias("spans")),
        lambda a: a.spans)
    kept = F.filter(found, lambda s: _valid(kind, s.value))
    return F.when(text.contains(_NEEDS[kind]) & text.rlike(pattern), kept).otherwise(F.array().cast(f"array<{_SPAN}>"))


def clean(text: Column) -> Column:
    """Null as empty; the mark is replaced with another control character, which no pattern holds."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.contains(_MARK), F.translate(plain, _MARK, "\x02")).otherwise(plain)


def base_spans(text: Column) -> Column:
    """Spans of the four fixed kinds, by start and then by kind as listed."""
    plain = clean(text)
    found = F.concat(*(matches(plain, kind, pattern) for kind, pattern in zip(BASE, (EMAIL, IP, CARD, PHONE))))
    return ordered(found)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def ordered(spans: Column) -> Column:
    rows = F.transform(spans, lambda s: F.struct(s.start.alias("start"), _rank(s.kind).alias("rank"), s.end.alias("end"), s.value.alias("value"), s.kind.alias("kind")))
    return F.transform(F.array_sort(rows), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value")))


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


_EDGES = r"^[^\p{L}\p{N}+(]+|[^\p{L}\p{N})]+$"
#: Between these marks stand a seed's kind and its value, in which a space is the last of them.
_SEED, _END, _GAP = "\x01", "\x02", "\x03"

def marked(text: Column, spans: Column) -> Column:
    """The text with each seed between marks and without space, so that it lies in one word; of overlapping ones the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    plain = F.translate(clean(text), _END + _GAP, "\x04\x04")
    return F.when(F.size(spans) == 0, plain).otherwise(F.aggregate(spans, start, lambda a, s: F.when(s.start < a.at, a).otherwise(F.struct(
        s.end.alias("at"), F.concat(a.out, F.substring(plain, a.at + 1, s.start - a.at), F.lit(_SEED), s.kind, F.lit(_SEED),
                                    F.translate(s.value, " ", _GAP), F.lit(_END)).alias("out"))),
        lambda a: F.concat(a.out, F.substring(plain, a.at + 1, F.length(plain)))))


def _bare(piece: Column) -> Column:
    """A piece of a marked text as it stands in the text."""
    return F.when(piece.contains(_SEED), F.translate(F.regexp_replace(piece, f"{_SEED}[a-z]+{_SEED}", ""), _GAP + _END, " ")).otherwise(piece)


def instances(texts: DataFrame) -> DataFrame:
    """All columns but `marked`, and pos, piece, value, patterns and kind (null: not a seed) of every word.

    A piece is a word with the space behind it; patterns are hashes of the words to the left and right on the same line.
    A word that holds seeds stands for each of them.
    """
    keys = [c for c in texts.columns if c != "marked"]
    cut = texts.withColumn("p", F.split("marked", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"))
    cut = cut.withColumn("near", F.transform("p", lambda x: F.lower(F.regexp_replace(_bare(x), _EDGES, ""))))
    piece, near = (lambda i: F.get("p", i)), (lambda i: F.get("near", i))
    joined = lambda i: ~piece(i).contains("\n")
    around = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.struct(
        i.alias("pos"), piece(i).alias("piece"), near(i).alias("value"), F.when(joined(i - 1), near(i - 1)).alias("one"),
        F.when(joined(i - 1) & joined(i - 2), near(i - 2)).alias("two"), F.when(joined(i), near(i + 1)).alias("behind")))
    rows = cut.select(*keys, F.explode(around).alias("w")).select(*keys, "w.*").filter("value != ''")
    one, two, behind = F.col("one"), F.col("two"), F.col("behind")
    patterns = F.array_compact(F.array(
        F.when(one.isNotNull(), F.xxhash64(F.lit(1), one)), F.when(two.isNotNull(), F.xxhash64(F.lit(2), two, one)),
        F.when(one.isNotNull() & behind.isNotNull(), F.xxhash64(F.lit(3), one, behind))))
    rows = rows.select(*keys, "pos", "piece", "value", patterns.alias("patterns"))
    plain = rows.filter(~F.col("piece").contains(_SEED)).withColumn("kind", F.lit(None).cast("string"))
    seed = f"{_SEED}([a-z]+){_SEED}([^{_END}]*){_END}"
    found = F.arrays_zip(F.regexp_extract_all("piece", F.lit(seed), F.lit(1)).alias("kind"), F.regexp_extract_all("piece", F.lit(seed), F.lit(2)).alias("value"))
    seeds = rows.filter(F.col("piece").contains(_SEED)).withColumn("s", F.explode(found)).select(
        *keys, "pos", "piece", F.lower(F.translate(F.col("s")["value"], _GAP, " ")).alias("value"), "patterns", F.col("s")["kind"].alias("kind"))
    return plain.unionByName(seeds)


#: What lies between two words without their edges: closing characters, space, opening characters. Repeats are possessive
#: and closing characters are tried from their first one only, so cutting is linear.
_CLOSING, _SPACE, _OPENING = r"[^\p{L}\p{N})\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]", r"[^\p{L}\p{N}+(\x20\x09-\x0D]"
_CLOSED = f"(?={_CLOSING})(?<!{_CLOSING}){_CLOSING}++"  # looks ahead first, which is cheaper
_BETWEEN = f"(?:{_CLOSED})?{_SPACE}++{_OPENING}*+"
#: What a line begins and ends with besides words, with the space outside it.
_ENDS = f"(?dm)^(?:{_SPACE}++{_OPENING}*+|{_OPENING}++)|{_CLOSED}{_SPACE}*+$|{_SPACE}++$"
#: Bits that tell which patterns are asked for: a fixed 128 KB, whatever their number. False alarms only cost time.
_BITS = 20
#: A pattern is left out if its values, estimated, are so many times what it could be trusted with.
SLACK = 4


def _pattern(kind: int, *words: Column) -> Column:
    return F.xxhash64(F.lit(kind), *words)


def _bit_table(patterns: DataFrame) -> Column:
    return bit_table(patterns.select("pattern"), _BITS)


def _in(table: Column, pattern: Column) -> Column:
    return in_table(table, pattern, _BITS)


def cut_lines(texts: DataFrame) -> DataFrame:
    """`words` of the texts without seeds: in lower case, without their edges, a mark between two.

    Whole texts are cut at once, so an expression is compiled once and not for every line.
    """
    # The mark of cut texts is no letter, so it is an edge like any other.
    plain = texts.filter(~F.col("marked").contains(_SEED))
    bare = F.regexp_replace(F.regexp_replace(F.lower("marked"), _ENDS, ""), _BETWEEN, _SEED)
    return plain.select(bare.alias("words"))


def standing(texts: DataFrame, supported: Column, asked: Column | None) -> DataFrame:
    """value and patterns of words in texts without seeds, which may be cut already (cut_lines): words with a digit, with all their
    patterns, and words at a pattern that is asked for (None: no pattern is), with those. Words are chosen within the text's arrays;
    others make no rows.

    A seed that stands at a longer pattern stands at its one-word pattern too. So a word can only be at a pattern that seeds
    support if the word before it is, which is looked up first.
    """
    line = lambda x: F.struct(F.split(x, _SEED).alias("w"), x.rlike("[0-9]").alias("digit"))
    chosen_from = texts if "words" in texts.columns else cut_lines(texts)
    if asked is None:
        chosen_from = chosen_from.filter(F.col("words").rlike("[0-9]"))
    cut = chosen_from.select(F.transform(F.filter(F.split("words", "\n"), lambda x: x.contains(_SEED)), line).alias("lines"))

    def chosen(row: Column) -> Column:
        w = row["w"]
        one, two, three = (lambda i: _pattern(1, F.get(w, i - 1))), (lambda i: _pattern(2, F.get(w, i - 2), F.get(w, i - 1))), (
            lambda i: _pattern(3, F.get(w, i - 1), F.get(w, i + 1)))
        digit = lambda i: row["digit"] & F.get(w, i).rlike("[0-9]")
        at = lambda i: _in(supported, one(i)) & (_in(asked, one(i)) | ((i > 1) & _in(asked, two(i))) | ((i + 1 < F.size(w)) & _in(asked, three(i))))
        here = digit if asked is None else lambda i: digit(i) | at(i)
        places = F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: here(i) & (F.get(w, i) != ""))
        return F.when((F.size(w) > 1) & (row["digit"] if asked is None else F.lit(True)), F.transform(places, lambda i: F.struct(
            F.get(w, i).alias("value"), digit(i).alias("digit"), one(i).alias("one"), F.when(i > 1, two(i)).alias("two"),
            F.when(i + 1 < F.size(w), three(i)).alias("three")))).otherwise(F.array().cast(
                "array<struct<value:string,digit:boolean,one:bigint,two:bigint,three:bigint>>"))

    rows = cut.select(F.explode(F.flatten(F.transform("lines", chosen))).alias("w")).select("w.*")
    each = rows.select("value", "digit", F.explode(F.array("one", "two", "three")).alias("pattern")).filter("pattern IS NOT NULL")
    wanted = F.col("digit") if asked is None else F.col("digit") | _in(asked, F.col("pattern"))
    return each.filter(wanted).select("pattern", "value")


def seeds_of(texts: DataFrame) -> DataFrame:
    """Staged distinct (pattern, value, kind) of the seeds."""
    return staged(instances(texts.filter(F.col("marked").contains(_SEED))).filter("kind IS NOT NULL").select(
        F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "seeds")


def beside_seeds(texts: DataFrame, supported: DataFrame) -> DataFrame:
    """Staged distinct (pattern, value) of other words in texts with seeds: at supported patterns, and with a digit at any."""
    table = _bit_table(supported)
    rows = instances(texts.filter(F.col("marked").contains(_SEED))).filter("kind IS NULL").select(F.explode("patterns").alias("pattern"), "value")
    return staged(rows.filter(_in(table, F.col("pattern")) | F.col("value").rlike("[0-9]")).distinct(), "beside-seeds")


def sizes_of(lines: DataFrame, seeds: DataFrame, beside: DataFrame, supported: DataFrame) -> DataFrame:
    """Staged supported patterns with about how many values stand at them; counted in sketches, so no pair of them travels."""
    table = _bit_table(supported)
    near = seeds.select("pattern", "value").unionByName(beside)
    every = standing(lines, table, table).unionByName(near.filter(_in(table, F.col("pattern"))))
    return staged(every.groupBy("pattern").agg(F.approx_count_distinct("value").alias("values")).join(supported, "pattern"), "pattern-sizes")


def edges_of(lines: DataFrame, seeds: DataFrame, beside: DataFrame, sizes: DataFrame, learned: int = 0, confidence: float = CONFIDENCE) -> DataFrame:
    """The distinct (pattern, value, kind) that trust can come from: every word at a supported pattern that could be trusted
    if `learned` values were added to its seeds, and at patterns that no seeds support the seeds and words with a digit.

    A pattern is trusted if most of its values are known. One with far more values cannot be, so it is left out whole.
    """
    rated = sizes.select("pattern", (F.col("values") <= SLACK * (F.col("n") + learned) / confidence + 100).alias("hopeful"))
    hopeful = rated.filter("hopeful")
    plain = standing(lines, _bit_table(sizes), None if hopeful.isEmpty() else _bit_table(hopeful)).unionByName(beside)
    rows = plain.withColumn("kind", F.lit(None).cast("string")).unionByName(seeds).join(rated, "pattern", "left")
    return rows.filter(F.coalesce("hopeful", F.col("kind").isNotNull() | F.col("value").rlike("[0-9]"))).select("pattern", "value", "kind").distinct()


def bootstrap(texts: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """learn() over edges that hold every pattern which could come to be trusted: more of them as more is learned."""
    seeds = seeds_of(texts)
    supported = staged(seeds.groupBy("pattern").agg(F.count_distinct("value").alias("n")).filter(F.col("n") >= support), "supported")
    beside = beside_seeds(texts, supported)
    lines = staged(cut_lines(texts), "cut-lines")
    sizes, reach = sizes_of(lines, seeds, beside, supported), 0
    while True:
        learned, trusted = learn(staged(edges_of(lines, seeds, beside, sizes, reach), "pattern-edges"), seeds.select("value", "kind").distinct())
        found = learned.count()
        if found <= reach:
            return learned, trusted
        reach = 2 * found


def learn(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """value, kind and score of identifiers that are no seeds and end above the confidence; pattern, kind and trust.

    `edges` holds the distinct (pattern, value, kind), kind null where the value is no seed, and `seeds` the distinct (value,
    kind) of all seeds. Each round scores patterns by
    the share of their values that are known to be of a kind, then values by the patterns they stand at (one minus the
    product of the patterns' doubts). Everything is counted by grouping; no group is gathered.
    """
    spark = edges.sparkSession
    seeds = seeds.withColumn("weight", F.lit(1.0))
    known, learned = seeds, spark.createDataFrame([], "value string, kind string, score double")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    pairs = edges.select("pattern", "value").distinct()
    for turn in range(rounds):
        hits = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.sum("weight").alias("hit"), F.count("*").alias("n"))
        good = staged(hits.filter(F.col("n") >= support).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("hit") / (F.col("values") + 1)).alias("trust")).filter(F.col("trust") >= confidence), f"trusted-{turn}")
        unseen = edges.filter("kind IS NULL").select("pattern", "value").distinct().join(good, "pattern").join(
            seeds.select("value").distinct(), "value", "left_anti")
        scored = unseen.groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        learned = staged(best.filter(F.col("score") >= confidence), f"learned-{turn}")
        if learned.isEmpty():
            break
        known = seeds.unionByName(learned.select("value", "kind", F.col("score").alias("weight")))
    return learned, good


def learned_spans(texts: DataFrame, learned: DataFrame, trusted: DataFrame) -> DataFrame:
    """text_key and span of the learned identifiers; `texts` holds distinct text_key and marked."""
    found = staged(instances(texts).filter("kind IS NULL").select("text_key", "pos", "value", "patterns").join(learned.select("value", "kind"), "value"), "learned-words")
    plain = found.filter(~F.col("value").rlike("[0-9]")).withColumn("pattern", F.explode("patterns")).join(
        trusted.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("text_key", "pos", "value", "kind").distinct()
    hits = found.filter(F.col("value").rlike("[0-9]")).select("text_key", "pos", "value", "kind").unionByName(plain)
    # Where the pieces of these texts begin: a running sum within one text.
    pieces = texts.join(hits.select("text_key").distinct(), "text_key", "left_semi").select(
        "text_key", F.posexplode(F.split("marked", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")).alias("pos", "piece")).withColumn("bare", _bare(F.col("piece")))
    ends = F.sum(F.length("bare")).over(Window.partitionBy("text_key").orderBy("pos"))
    lead = F.length("bare") - F.length(F.regexp_replace("bare", r"^[^\p{L}\p{N}+(]+", ""))
    placed = pieces.select("text_key", "pos", (ends - F.length("bare") + lead).cast("int").alias("start"), F.length(F.regexp_replace("bare", _EDGES, "")).alias("size"))
    return hits.join(placed, ["text_key", "pos"]).select("text_key", F.struct(
        F.concat(F.lit("like_"), "kind").alias("kind"), "start", (F.col("start") + F.col("size")).alias("end"), "value").cast(_SPAN).alias("span"))


def find(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `documents` with base_spans and spans (kind, start, end, value), in code points, end exclusive.

    spans are the base spans and, after them in the order of kinds, the learned ones (like_email and so on). Evidence is
    counted once per different text. A null text is an empty one; null keys, repeated rows and extra columns are kept as
    they are, columns of these two names are replaced; an empty table stays empty.
    """
    kept = [c for c in documents.columns if c not in ("base_spans", "spans")]
    based = documents.select(*kept, base_spans(F.col(text)).alias("base_spans"))
    sources = documents.select(F.col(text).alias("text")).filter(F.octet_length("text") > 0)
    texts = staged(sources.select(marked(F.col("text"), base_spans(F.col("text"))).alias("marked")), "marked-texts")
    learned, trusted = bootstrap(texts)
    if learned.isEmpty():
        return based.withColumn("spans", F.col("base_spans"))
    key_of = F.sha2(F.col(text).cast("binary"), 256)
    keyed = sources.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), marked(F.col("text"), base_spans(F.col("text"))).alias("marked"))
    more = learned_spans(staged(keyed.dropDuplicates(["text_key"]), "keyed-texts"), learned, trusted)
    # Spans of one text: as many as it has words at most.
    grouped = staged(more.groupBy("text_key").agg(F.collect_list("span").alias("_more")), "learned-spans")
    none = F.array().cast(f"array<{_SPAN}>")
    return based.withColumn("_text_key", key_of).join(grouped, F.col("_text_key") == F.col("text_key"), "left").withColumn(
        "spans", ordered(F.concat("base_spans", F.coalesce("_more", none)))).drop("_text_key", "text_key", "_more")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one wins."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.coalesce(text, F.lit(""))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, lambda a, s: F.when(s.start < a.at, a).otherwise(F.struct(
        s.end.alias("at"), F.concat(a.out, F.substring(body, a.at + 1, s.start - a.at), F.lit("<"), s.kind, F.lit(">")).alias("out"))),
        lambda a: F.concat(a.out, F.substring(body, a.at + 1, F.length(body)))))


__all__ = ["base_spans", "find", "instances", "learn", "masked", "matches", "ordered", "spelled"]
