"""Removes repeated and nearly repeated lines by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its words in lower case. Lines with one set are a class, and its first line in the corpus order
(doc_id with nulls first, then the document's hash, then the line's number) stays unless an earlier line of another
class has a Jaccard similarity of SIMILARITY or more; every later line of a class goes.

Words are ordered by rarity: by their number in the corpus in lower case, counted in hash buckets over all texts (a
table of 2**BUCKETS numbers, which is what tasks get), then by hash. Any fixed order gives exact results; a rarer one gives fewer candidates.
Two sets of sizes n and m with similarity t or more share a word among the first n - ceil(t n) + 1 of one and the like of
the other (prefix filter); their sizes differ by a factor of t at most (length filter); what is left from the first
shared word's places on must suffice (positional filter); and a parity sketch of each set, of 64 bits or, for more than 64
words, 128, gives a lower bound of their symmetric difference. All four are conditions of one sort-merge join on words. A pair that shares a run of prefix
words is met at the run's start only.

A word that occurs more than HOT times is no key by itself: two sets whose first shared word is such a word share a
second one in prefixes that are longer by one, so they meet by both words. Rarer words come first, so the prefixes of
most lines hold no such word.

Families of near copies are settled first: where FAMILY classes or more have one word as the smallest or largest hash, the
last or the middle word of their prefix, each is held against the earliest of them. What is similar to that needs no other
candidate, so that a family costs about its size, not its square; only its members that are unlike the earliest meet all
others. Where the squares of the families come to less than the number of classes, there is nothing to save, and no line
is settled first. Of the other lines' candidates the first is verified first, the rest only for lines that it does not
settle. All pairs are verified on the
words themselves (64-bit hashes); prefixes hold 30 bits of them, which can only add candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import discard, table, written

#: The least similarity, as a fraction.
SIMILARITY = (4, 5)

#: Binary logarithm of the number of buckets that words are counted in.
BUCKETS = 20

#: Words that occur more often are keys only together with a second word.
HOT = 1 << 14

#: The least number of classes with one such prefix word that are held against the earliest of them.
FAMILY = 256

#: Binary logarithms of the least and most bits of the filter that finds the lines to verify in the texts.
FILTER_BITS = (12, 26)

#: Ranks are binary logarithms in steps of 1 / SCALE, above the 48 bits of a code that come from the hash.
_SCALE, _HASH_BITS, _WORD_BITS = 256, 48, 30


def blanks(text: Column) -> Column:
    """The text with blanks for all white space within its lines; most texts hold no other and stay as they are."""
    odd = F.lit(False)
    for c in "\t\r\v\f":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, "\t\r\v\f", "    ")).otherwise(text)


def words_of(line: Column) -> Column:
    """The words of a line of lines_of, in lower case and in order; it may hold empty strings.

    What a lambda function reads is evaluated without generated code and without sharing, so this is as short as can be.
    """
    return F.split(F.lower(line), " ")


def _low(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _dense(counts: DataFrame, key: str, value: str, bits: int) -> DataFrame:
    """One row with an array of 2**bits values, for keys from 0 on; zero for keys that counts lacks."""
    spark, chunk = counts.sparkSession, bits // 2
    zeros = spark.range(1 << bits).select(F.col("id").alias(key), F.lit(0).cast("long").alias(value))
    full = counts.select(F.col(key).cast("long").alias(key), F.col(value).cast("long").alias(value)).unionByName(zeros).groupBy(key).agg(F.sum(value).alias(value))
    parts = full.groupBy(F.shiftright(key, chunk).alias("c")).agg(F.sort_array(F.collect_list(F.struct(key, value)))[value].alias("v"))
    return parts.agg(F.flatten(F.sort_array(F.collect_list(F.struct("c", "v")))["v"]).alias("v"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, doc (hash of doc_id and text), pos (from 0), line of every line, its white space as blanks; a null text is one empty line.

    The hash stands in a projection of its own, or it would be taken once for each line; the outer form of the
    generator, since for the inner one Spark adds a filter that splits every text once more.
    """
    hashed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), blanks(F.coalesce("text", F.lit(""))).alias("text"))
    return hashed.select("doc_id", "doc", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: for each hash bucket of words, how frequent they are in all texts, on a logarithmic scale (0: absent)."""
    lines = docs.select(F.explode_outer(F.split(blanks(F.coalesce("text", F.lit(""))), "\n")).alias("line"))
    words = lines.select(F.explode_outer(words_of(F.col("line"))).alias("w")).select(_low(F.xxhash64("w"), buckets).alias("b"))
    counted = words.groupBy("b").agg(F.count("*").alias("n")).select("b", (F.log2(F.col("n") + 1) * _SCALE).cast("long").alias("r"))
    # Two bytes a number: tasks look numbers up at random, and a quarter of the table stays in the processor's cache.
    return written(_dense(counted, "b", "r", buckets).select(F.col("v").cast("array<smallint>").alias("v")), "lines-rarity")


def word_hashes(line: Column) -> Column:
    """The distinct words of a line, as hashes."""
    return F.array_remove(F.array_distinct(F.transform(words_of(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def word_sets(lines: DataFrame, ranks: DataFrame, buckets: int = BUCKETS, hot: int = HOT) -> DataFrame:
    """Lines: the codes of their sets of words, rarest first, as hashes h1 and h2, size n, sketch, half and prefix.

    sketch is the parity of 64 bits; in half only words with another bit count, and only if there are more than 64.
    The prefix has one word more than the prefix filter asks for; a word is 30 bits of its code, and one above them if
    it occurs more than `hot` times. Lines without words have n = 0. To be filtered once written: a filter here would
    move below and make the sets twice.
    """
    top, bottom = SIMILARITY
    hashed = lines.select("doc_id", "doc", "pos", word_hashes(F.col("line")).alias("hashes"))
    # Never null, as its type has to say: then arrays of codes are sorted as plain longs.
    rank = lambda h: F.coalesce(F.col("ranks")[_low(h, buckets)], F.lit(0).cast("smallint")).cast("long")
    code = lambda h: F.shiftleft(rank(h), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS))
    # Read twice here, the hashes stay a projection of their own, in generated code; the ranks must not become a column of it.
    sized = hashed.select("doc_id", "doc", "pos", "hashes", F.size("hashes").alias("n"), ranks.scalar().alias("ranks"))
    coded = sized.select("doc_id", "doc", "pos", "n", F.sort_array(F.transform("hashes", code)).alias("codes"))
    n, often = F.col("n"), F.lit(int(math.log2(hot + 1) * _SCALE) + 1 << _HASH_BITS)
    word = lambda c: F.when(c < often, _low(c, _WORD_BITS)).otherwise(_low(c, _WORD_BITS).bitwiseOR(F.lit(1 << _WORD_BITS))).cast("int")
    parity = lambda bit: F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(bit(c)))
    half = lambda c: F.when(c.bitwiseAND(F.lit(64)) == 0, F.lit(0).cast("long")).otherwise(_bit(_low(c, 6)))
    return coded.select(
        "doc_id", "doc", "pos", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit("second"), "codes").alias("h2"), n.alias("n"),
        parity(lambda c: _bit(_low(c, 6))).alias("sketch"),
        F.when(n > 64, parity(half)).otherwise(F.lit(0).cast("long")).alias("half"),
        F.transform(F.slice("codes", 1, n - F.ceil(n * top / bottom).cast("int") + 2), word).alias("prefix"),
    )


def doc_key(doc_id: str) -> Column:
    """doc_id as a long, the smallest one for null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def ordered(doc_id: str, doc: str, pos: str) -> tuple[Column, Column]:
    """doc and line, two longs in corpus order: doc_id, null first; then 32 bits of the document's hash and the line's number."""
    line = F.shiftleft(F.shiftright(doc, 32), 31).bitwiseOR(F.col(pos).cast("long"))
    return doc_key(doc_id).alias("doc"), line.alias("line")


def _near(a_n: Column, b_n: Column) -> Column:
    """Sketch filter and length filter; of two long sets, the halves of the sketches are compared apart as well.

    Whole sketches come first: their difference is a bound for sets of any size, and few pairs need anything else.
    """
    top, bottom = SIMILARITY
    total, whole, half = a_n + b_n, F.col("a_sketch").bitwiseXOR(F.col("b_sketch")), F.col("a_half").bitwiseXOR(F.col("b_half"))
    # b (T - D) >= t (T + D) for a similarity of t / b, T words together and D in one set alone: whole numbers, no division.
    few = lambda differ: differ * (bottom + top) <= total * (bottom - top)
    short = (a_n <= 64) | (b_n <= 64)
    return few(F.bit_count(whole)) & (a_n * bottom >= b_n * top) & (b_n * bottom >= a_n * top) & (short | few(F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))))


def _before() -> Column:
    return (F.col("a_doc") < F.col("b_doc")) | ((F.col("a_doc") == F.col("b_doc")) & (F.col("a_line") < F.col("b_line")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.struct(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).alias("early"), F.col("b_doc").alias("doc"), F.col("b_line").alias("line"))


def few_of(prefix: str) -> Column:
    """The words of a prefix by which families are found: the smallest, the largest, the last and the middle one."""
    return F.array_distinct(F.array(F.array_min(prefix), F.array_max(prefix), F.element_at(prefix, -1), F.element_at(prefix, F.shiftright(F.size(prefix), 1) + 1)))


def family_pairs(classes: DataFrame, family: int = FAMILY) -> DataFrame:
    """(early, late) lines: the earliest class and each other of those with one smallest, largest, last or middle prefix word."""
    if "few" not in classes.columns:
        classes = classes.withColumn("few", few_of("prefix"))
    ends = classes.select("doc", "line", "n", "sketch", "half", F.explode_outer("few").alias("word"))
    large = written(ends.groupBy("word").agg(F.count("*").alias("many")).filter(F.col("many") >= family).select("word"), "lines-large")
    members = written(ends.join(large, "word"), "lines-members")
    columns = ("doc", "line", "n", "sketch", "half")
    leaders = written(members.groupBy("word").agg(F.min(F.struct(*columns)).alias("a")).select("word", *[F.col(f"a.{c}").alias(f"a_{c}") for c in columns]), "lines-leaders")
    met = members.select("word", *[F.col(c).alias(f"b_{c}") for c in columns]).join(leaders, "word")
    met = met.filter(_before() & _near(F.col("a_n"), F.col("b_n")))
    out = written(_pairs(met).distinct(), "lines-families")
    discard(large, members, leaders)
    return out


def prefix_rows(classes: DataFrame) -> DataFrame:
    """One row for each key of a class: word, doc and line of its first line, prev, place, sketch, half.

    The key is a prefix word, or two of them where the first is frequent. place has the size and the key's place, less
    one for two words; it is negative for settled classes. prev is the prefix word before, -1 if none counts.
    """
    often = F.lit(1 << _WORD_BITS)
    sign = F.when(F.col("settled"), F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
    pack = lambda at: F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(at.cast("long")).bitwiseOR(sign).alias("place")
    kept = ["doc", "line", "n", "sketch", "half", "settled"]
    many = F.col("n") >= 2  # two different sets of which one has a single word are not similar
    last = F.size("prefix") - 1
    each = classes.filter(many).select(*kept, "prefix", F.posexplode(F.slice("prefix", 1, F.greatest(last, F.lit(1)))).alias("at", "word"))
    prev = F.when(F.col("at") > 0, F.get("prefix", F.col("at") - 1)).otherwise(F.lit(-1)).alias("prev")
    single = each.filter(F.col("word") < often).select("word", "doc", "line", prev, pack(F.col("at")), "sketch", "half")
    hot = classes.filter(many & (F.element_at("prefix", -1) >= often)).select(*kept, "prefix", F.posexplode(F.slice("prefix", 1, F.greatest(last, F.lit(1)))).alias("first", "word")).filter(F.col("word") >= often)
    both = hot.select(*kept, "first", "word", F.posexplode(F.slice("prefix", F.col("first") + 2, F.size("prefix"))).alias("then", "second"))
    key = _low(F.xxhash64("word", "second"), _WORD_BITS).cast("int").bitwiseOR(often).alias("word")
    double = both.select(key, "doc", "line", F.lit(-1).alias("prev"), pack(F.col("first") + F.col("then")), "sketch", "half")
    return single.unionByName(double)


def candidates(rows: DataFrame) -> DataFrame:
    """(early, late) lines, as structs of doc and line, for the prefix rows that all filters let through.

    A late line has to be open. No condition concerns one side alone, so rows of either kind are shuffled once and
    sorted twice: nothing is left of a settled line in the positional filter. The cheapest filter comes first.
    """
    columns = ("doc", "line", "prev", "place", "sketch", "half")
    a = rows.select("word", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select("word", *[F.col(c).alias(f"b_{c}") for c in columns])
    a_n, b_n = (F.shiftright(F.shiftleft(place, 1), 32) for place in ("a_place", "b_place"))
    a_left, b_left = a_n - _low(F.col("a_place"), 31), F.when(F.col("b_place") >= 0, b_n - _low(F.col("b_place"), 31)).otherwise(-1)
    top, bottom = SIMILARITY
    left = F.least(a_left, b_left) * (bottom + top) >= (a_n + b_n) * top
    first = (F.col("a_prev") != F.col("b_prev")) | (F.col("a_prev") + F.col("b_prev") < 0)
    return _pairs(a.join(b, "word").filter(_near(a_n, b_n) & _before() & left & first))


def word_lists(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, line and words (hashes) of the wanted lines (doc, line; distinct).

    A filter of 16 bits or more for each line and each of their documents sifts the documents before they are cut into
    lines, and the lines before they move.
    """
    bits = min(max((32 * wanted.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = lambda *key: _low(F.xxhash64(*key), bits)
    slots = wanted.select(F.explode(F.array(slot("doc", "line"), slot("doc"))).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("w"), _bit(F.col("slot").bitwiseAND(F.lit(63))).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bit"))
    sieve = written(_dense(words, "w", "bit", bits - 6).withColumnRenamed("v", "bits"), "lines-filter")

    def sifted(df: DataFrame, at: Column) -> DataFrame:
        word = sieve.scalar()[F.shiftright(at, 6).cast("int")]
        return df.filter(F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)

    some = lines_of(sifted(docs, slot(doc_key("doc_id")))).select(*ordered("doc_id", "doc", "pos"), F.col("line").alias("text"))
    some = sifted(some, slot("doc", "line"))
    lists = some.select("doc", "line", word_hashes(F.col("text")).alias("words")).join(wanted, ["doc", "line"]).dropDuplicates(["doc", "line"])
    lists = written(lists, "lines-words")
    discard(sieve)
    return lists


def lines_in(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc", "line").unionByName(pairs.select("early.doc", "early.line")).distinct()


def similar(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """doc and line of the late lines of those pairs (early, doc, line) whose word sets are similar enough."""
    top, bottom = SIMILARITY
    one = lists.select(F.struct("doc", "line").alias("early"), F.col("words").alias("x"))
    two = lists.select("doc", "line", F.col("words").alias("y"))
    both = pairs.join(one, "early").join(two, ["doc", "line"])
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * bottom >= (F.size("x") + F.size("y") - common) * top).select("doc", "line").distinct()


def similar_classes(docs: DataFrame, classes: DataFrame, family: int = FAMILY) -> DataFrame:
    """doc and line of the first lines of the classes for which an earlier similar class exists."""
    near = family_pairs(classes, family)
    squares = near.groupBy("early").agg(F.count("*").cast("double").alias("many")).agg(F.sum(F.col("many") * F.col("many"))).first()[0] or 0
    if large := squares > classes.count():
        lists = word_lists(docs, written(lines_in(near), "lines-wanted"))
        settled = written(similar(near, lists), "lines-settled")
        discard(near, lists)
        marked = classes.join(settled.withColumn("settled", F.lit(True)), ["doc", "line"], "left")
    else:
        marked = classes.withColumn("settled", F.lit(False))
    pairs = written(candidates(prefix_rows(marked)).distinct(), "lines-pairs")
    lists = word_lists(docs, written(lines_in(pairs), "lines-wanted"))
    earliest = written(similar(pairs.groupBy("doc", "line").agg(F.min("early").alias("early")), lists), "lines-settled")
    later = written(similar(pairs.join(earliest, ["doc", "line"], "left_anti"), lists), "lines-settled")
    discard(pairs, lists)
    found = earliest.unionByName(later)
    return settled.unionByName(found) if large else found


def removed_lines(docs: DataFrame, buckets: int = BUCKETS, hot: int = HOT, family: int = FAMILY) -> DataFrame:
    """doc_id, doc, n_lines (those with words), removed (the numbers of its removed lines, ascending) of every document.

    doc is the hash of doc_id and text; rows alike in both are one document here, and all of them are returned. Null and
    empty texts have no lines; an empty table gives an empty result. buckets, hot and family change the cost alone.
    """
    docs = docs.select("doc_id", "text")
    ranks = rarity(docs, buckets)
    sets = written(word_sets(lines_of(docs), ranks, buckets, hot), "lines-sets")
    first = F.min(F.struct("doc_id", "doc", "pos", "n", "sketch", "half", "prefix")).alias("first")
    classes = sets.filter("n > 0").groupBy("h1", "h2").agg(first, F.count("*").alias("many"))
    classes = written(classes.select("h1", "h2", *ordered("first.doc_id", "first.doc", "first.pos"), "many", "first.n", "first.sketch", "first.half", "first.prefix", few_of("first.prefix").alias("few")), "lines-classes")
    gone = similar_classes(docs, classes, family).withColumn("gone", F.lit(True))
    verdicts = classes.select("h1", "h2", "many", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"))
    verdicts = verdicts.join(gone, (F.col("first_doc") == gone.doc) & (F.col("first_line") == gone.line), "left").filter("many > 1 or gone")
    verdicts = written(verdicts.select("h1", "h2", "first_doc", "first_line", F.coalesce("gone", F.lit(False)).alias("gone")), "lines-verdicts")
    judged = sets.select("h1", "h2", "doc_id", "doc", "pos").join(verdicts, ["h1", "h2"])
    doc, line = ordered("doc_id", "doc", "pos")
    removed = judged.filter(F.col("gone") | (doc != F.col("first_doc")) | (line != F.col("first_line"))).groupBy("doc_id", "doc").agg(F.sort_array(F.collect_set("pos")).alias("removed"))
    removed = removed.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "removed")
    counted = sets.groupBy("doc_id", "doc").agg(F.count(F.when(F.col("n") > 0, 1)).alias("lines"), F.count(F.when(F.col("pos") == 0, 1)).alias("rows"))
    out = counted.join(removed, counted.doc_id.eqNullSafe(removed._id) & (counted.doc == removed._doc), "left")
    out = written(out.select("doc_id", "doc", F.expr("lines div rows").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "rows"), "lines-removed")
    discard(ranks, sets, classes, verdicts)
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("_row", "rows")


def dedup(docs: DataFrame, buckets: int = BUCKETS, hot: int = HOT, family: int = FAMILY) -> DataFrame:
    """docs with their repeated lines taken out of text; all rows and columns stay.

    Lines without words stay where they are. A text whose lines all go is empty; a null text stays null.
    """
    gone = removed_lines(docs, buckets, hot, family).filter(F.size("removed") > 0).dropDuplicates(["doc_id", "doc"])
    gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "removed"), "lines-gone")
    keyed = docs.select(F.col("doc_id").alias("_own"), F.xxhash64("doc_id", "text").alias("_key"), F.struct(*docs.columns).alias("_cells"))
    joined = keyed.join(gone, keyed._own.eqNullSafe(gone._id) & (keyed._key == gone._doc), "left")
    text = F.col("_cells.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    reduced = F.when(F.col("removed").isNull(), text).otherwise(kept)
    return joined.select(*[(reduced if c.lower() == "text" else F.col("_cells").getField(c)).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES: dict[str, str] = {}
