"""Benchmark decontamination by item-sized windows, in DataFrame functions only.

A window is as many words of a document as a benchmark item has.  Windows are only
cut where one can pass: at a similarity of t, a window holds shingles of more than t
of the item's weight, hence one of any set of its shingles that weighs more than
1 - t.  Such a set is chosen for each item by its rarest words, and a window is cut
wherever a document has one of these shingles, so that both stand at the same place
in it.  Every window cut is compared with the item it was cut for, exactly, by the
Jaccard similarity of their word shingles, weighted and plain.

What stays out: a passage with words put in or left out that, at the places of all its
anchors, is under t, though at another start it would pass.

SimHash fingerprints (`simhash`, `blocks`) no longer choose the windows to compare, as a
radius loses some of similar ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.llm.common import light_enough, stored, text_key

BITS, LANES = 60, 3
PLANES = BITS // LANES
RADIUS = 14
BLOCK_BITS = BITS // (RADIUS + 1)
_MASK = sum(1 << (PLANES * i) for i in range(LANES))
#: Bytes of anchors, items or texts found that are broadcast at most.
MOST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """All runs of that many words, in order; of fewer words the whole, of none nothing."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))


def simhash(words: Column) -> Column:
    """Majority of the bits of the words' hashes, 60 bits.

    Counters of 20 bits are added up three to a number, so up to 2**19 words are counted exactly; a tie is a 0.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    mask = F.lit(_MASK).cast("long")
    lift = (F.lit((1 << (PLANES - 1)) - 1) - F.floor(F.size(words) / 2)).cast("long")
    out = F.lit(0).cast("long")

    def plane(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(mask))

    for k in range(PLANES):
        counts = plane(k)
        over = F.shiftrightunsigned(counts + lift * mask, PLANES - 1).bitwiseAND(mask)
        out = out.bitwiseOR(F.shiftleft(over, k))
    return out


def blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).alias("value")) for b in range(RADIUS + 1)])


def prepared_items(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Texts (text_id, n, words, sh, weights) and names (text_id, item_id).

    Items of the same words are one text, whose text_id is a hash of them, so an item_id may be null, repeated, or have
    several texts.  sh and weights: distinct shingles and their weights, 1 over the number of texts that have them.
    Items without a word are left out.
    """
    each = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").withColumn("text_id", F.sha2(F.array_join("words", " "), 256))
    items = each.groupBy("text_id").agg(F.first("words").alias("words")).withColumn("n", F.size("words"))
    items = items.withColumn("sh", F.array_distinct(shingles(F.col("words"), size)))
    df = items.select("text_id", F.explode("sh").alias("s")).groupBy("s").agg((1 / F.count("*")).alias("w"))
    weights = items.select("text_id", F.explode("sh").alias("s")).join(df, "s").groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("s", "w"))).alias("weights"))
    return items.join(weights, "text_id"), each.select("text_id", "item_id").distinct()


def anchors(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(word, at, offset, n, shingle, text_id): per text shingles of more than 1 - threshold of its weight, each with its rarest word; also more than 1 - threshold of their number, for the plain similarity.

    at: the place of the word in the shingle; offset: that of the shingle in the item.  Rare: in few items, then long.
    """
    df = items.select("text_id", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    placed = items.select("text_id", "n", "weights", F.posexplode(shingles(F.col("words"), size)).alias("offset", "shingle")).dropDuplicates(["text_id", "shingle"])
    words = placed.select("text_id", "n", "offset", "shingle", F.element_at("weights", F.col("shingle")).alias("w"), F.posexplode(F.split("shingle", " ")).alias("at", "word")).join(df, "word")
    best = words.groupBy("text_id", "n", "offset", "shingle", "w").agg(F.min(F.struct("df", (-F.length("word")).alias("len"), "at", "word")).alias("b"))
    order = W.partitionBy("text_id").orderBy("b.df", "b.len", "offset")
    whole = W.partitionBy("text_id")
    # Taken until the weight, and the number, before it exceed what may be missing.
    chosen = best.withColumns({"before": F.sum("w").over(order) - F.col("w"), "all": F.sum("w").over(whole), "nth": F.row_number().over(order) - 1, "many": F.count("*").over(whole)}).where((F.col("before") <= (1 - threshold) * F.col("all") + 1e-9) | (F.col("nth") <= (1 - threshold) * F.col("many") + 1e-9))
    return chosen.select(F.col("b.word").alias("word"), F.col("b.at").alias("at"), "offset", "n", "shingle", "text_id").distinct()


def _cut(docs: DataFrame, looked_for: DataFrame) -> DataFrame:
    """(doc_id, key, start, text_id, window) of the windows around anchors; looked_for is broadcast, so explode and join run in one pass and no word list is copied."""
    words = docs.select("doc_id", text_key("text").alias("key"), words_of(F.col("text")).alias("words"))
    # posexplode_outer: the plain one would have the words split twice, to filter empty ones first.
    hit = words.select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "word")).join(looked_for, "word")
    from_ = F.col("pos") - F.col("at")
    hit = hit.where((from_ >= 0) & (F.array_join(F.slice("words", F.greatest(from_, F.lit(0)) + 1, F.size(F.split("shingle", " "))), " ") == F.col("shingle")))
    start = F.greatest(from_ - F.col("offset"), F.lit(0))
    return hit.select("doc_id", "key", start.alias("start"), "text_id", F.slice("words", start + 1, F.col("n")).alias("window")).groupBy("doc_id", "key", "start", "text_id").agg(F.first("window").alias("window"))


def _cut_joined(docs: DataFrame, looked_for: DataFrame, size: int) -> DataFrame:
    """The same where anchors are too many to broadcast: runs of up to `size` words are dealt by run, and windows are cut from the documents afterwards, which are found again by their texts."""
    words = docs.select("doc_id", text_key("text").alias("key"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    whole = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.array_join(F.slice(w, i + 1, k), " ")).alias("runs")))
    bound = F.get(F.transform(F.array("words"), whole), F.lit(0))
    each = words.select("key", F.explode(bound).alias("e")).select("key", "e.pos", F.explode(F.array_distinct("e.runs")).alias("shingle"))
    hit = each.join(looked_for, "shingle").select("key", F.greatest(F.col("pos") - F.col("offset"), F.lit(0)).alias("start"), "n", "text_id").distinct()
    by_text = hit.groupBy("key").agg(F.collect_list(F.struct("start", "n", "text_id")).alias("cuts"))
    both = words.join(by_text, "key").select("doc_id", "key", "words", F.explode("cuts").alias("c"))
    return both.select("doc_id", "key", "c.start", "c.text_id", F.slice("words", F.col("c.start") + 1, F.col("c.n")).alias("window")).groupBy("doc_id", "key", "start", "text_id").agg(F.first("window").alias("window"))


def _leaks(docs: DataFrame, benchmark: DataFrame, size: int, threshold: float, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, text_id, similarity, n_windows, first_word) of documents and the texts of items they repeat, by the key of the document's text; names of items."""
    texts, names = prepared_items(benchmark, size)
    items, names = stored(texts, "items"), stored(names, "names")
    looked_for = stored(anchors(items, size, threshold), "anchors")
    small = most_bytes and light_enough(looked_for, 96 + F.octet_length("shingle") + F.octet_length("word"), most_bytes)
    cut = _cut(docs, F.broadcast(looked_for)) if small else _cut_joined(docs, looked_for, size)
    known = items.select("text_id", "sh", "weights")
    # Shingles stand in it twice, in the list and in the map.
    light = most_bytes and light_enough(known, 128 + 2 * F.aggregate("sh", F.lit(0), lambda n, x: n + 24 + F.octet_length(x)), most_bytes)
    weighed = cut.join(F.broadcast(known) if light else known, "text_id").withColumn("own", F.array_distinct(shingles(F.col("window"), size)))
    weighed = weighed.withColumn("common", F.array_intersect("own", "sh"))

    def weight(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.element_at("weights", x))

    def over_either(worth) -> Column:
        return worth(F.col("common")) / (worth(F.col("sh")) + F.size("own") - F.size("common"))

    found = (
        weighed.withColumn("similarity", F.round(F.greatest(over_either(weight), over_either(F.size)), 6))
        .where(F.col("similarity") >= threshold - 1e-9)
        .groupBy("doc_id", "key", "text_id")
        .agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"))
    )
    return found, names


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows, first_word): the items that a document repeats and the best similarity.

    Similarity: the larger of two.  Weighted: weight of the common shingles over that of the shingles in either; an item's
    shingle weighs 1 over the number of items, of different words, that have it, any other 1.  Plain: their numbers.
    A null or empty text, or item, matches nothing; ties count as one.  Repeated rows of a doc_id count as one document, which has
    the windows of each of its different texts, and rows without an id as one under null; repeated rows of an item_id
    count as one item; a null item_id is reported as null.  No items: no rows.  Other columns are not read.
    """
    found, names = _leaks(docs, benchmark, size, threshold, most_bytes)
    # Names come last, so that items of the same words are compared once.
    small = most_bytes and light_enough(names, 96 + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)), most_bytes)
    return (
        found.join(F.broadcast(names) if small else names, "text_id")
        .groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), F.sum("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents whose text repeats no item, whole and as they were, whatever their doc_id is; repeated rows stay or go together."""
    found, _ = _leaks(docs, benchmark, size, threshold, most_bytes)
    found = stored(found.select(F.col("key").alias("leak")).distinct(), "leaks")
    small = most_bytes and light_enough(found, F.lit(48), most_bytes)
    found = F.broadcast(found) if small else found
    return docs.join(found, text_key("text") == found["leak"], "left_anti").select(docs.columns)
