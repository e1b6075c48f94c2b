"""Language identification by word-first backoff.

Known words are scored by their log frequency per language; a word that no
language knows falls back to its character n-grams, longest order first, down to
single letters.  Counts cover every training document, and every word and n-gram that
was counted is in the model: there is no floor.

A language's score of a word or n-gram that occurs n times among its N is log(1 + n M / (A N)), where M is the
largest N of any language: the log of its frequency over that of what was never seen, A / M, which is the
same for all languages and so cancels.  A word scores 0 in languages that lack it.

The model is a table of words and one of n-grams.  Its most frequent words, as many as a documented bound
allows, travel to the executors; texts are scored with these in one pass, which also gives the words that are left.
Those are looked up, once each, by joins with the whole tables, and their scores come back by text.  The bound
affects the way only: results are the same with no word sent at all.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitequarry.llm.common import as_batch, discard, drained, small_enough, stored, text_key

#: Runs of letters and of numerals that are neither digits nor letters, which are taken out afterwards: few texts have any.
RUN = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
FLUSH = 300_000
#: Occurrences that a word or n-gram which was never seen is taken to have in the largest language.
A = 0.5
#: Words sent to the executors, and numbers in their table (words times languages), at most.
MOST_WORDS, MOST_CELLS = 250_000, 2_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters, as isalpha has them, in lower case."""
    low = text.lower()
    words = RUN.findall(low)
    if not words or "".join(words).isalpha():
        return words
    return "".join(c if c.isalpha() else " " for c in low).split()


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with a blank on either side; single letters without."""
    w = f" {word} " if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """langs; words and grams: (gram, n, entries (l, s): the place and score of each language that has it); the words sent and their scores."""

    langs: list[str]
    words: DataFrame
    grams: DataFrame
    row: dict[str, int]
    table: np.ndarray


def _told(held: dict, names: list[str], types: list):
    """Rows of counters by key, and the counters emptied: the parts of the key, the entry, its count."""
    for key, counts in held.items():
        entries, n = list(counts), list(counts.values())
        for at in range(0, len(entries), 50_000):
            some = entries[at : at + 50_000]
            yield as_batch([*([part] * len(some) for part in key), some, n[at : at + 50_000]], types, names)
    held.clear()


def _count_words(batches):
    held: dict = defaultdict(Counter)
    names, types = ["lang", "gram", "n"], [pa.string(), pa.string(), pa.int64()]
    for b in drained(batches):
        for at in range(0, b.num_rows, 128):
            piece = b.slice(at, 128)
            for text, lang in zip(piece["text"].to_pylist(), piece["lang"].to_pylist(), strict=True):
                held[lang,].update(words_of(text))
            if sum(map(len, held.values())) > FLUSH:
                yield from _told(held, names, types)
    yield from _told(held, names, types)


def _count_grams(batches):
    """Of words all n-grams of the longest order, and the last one of each shorter order: the others are the beginnings of longer ones."""
    held: dict = defaultdict(Counter)
    names, types = ["lang", "size", "gram", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
    longest = ORDERS[0]
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            for lang, word, n in zip(*(b[c].slice(at, 4096).to_pylist() for c in ("lang", "gram", "n")), strict=True):
                own = held[lang, longest]
                for g in grams(word, longest):
                    own[g] += n
                w = f" {word} "
                for k in range(min(len(w), longest - 1), 1, -1):
                    held[lang, k][w[-k:]] += n
            if sum(map(len, held.values())) > FLUSH:
                yield from _told(held, names, types)
    yield from _told(held, names, types)


def _all_grams(words: DataFrame) -> DataFrame:
    """(lang, size, gram, n) of (lang, gram, n): an n-gram of a word is the beginning of one that is a letter longer, or the word's last; letters begin pairs."""
    counted = stored(words.mapInArrow(_count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    levels = [counted.where(F.col("size") == ORDERS[0])]
    for k in ORDERS[1:]:
        shorter = levels[-1].select("lang", F.substring("gram", 1, k).alias("gram"), "n").where("gram <> ' '")
        last = counted.where(F.col("size") == k).select("lang", "gram", "n")
        levels.append(stored(shorter.unionByName(last).groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", F.lit(k).alias("size"), "gram", "n"), "langid-grams"))
    return reduce(DataFrame.unionByName, levels)


def _scored(counts: DataFrame, langs: list[str], name: str) -> DataFrame:
    """(gram, n, entries) of (lang, size, gram, n)."""
    totals = {(r.lang, r.size): r.total for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()}
    most = {size: max(n for (_, k), n in totals.items() if k == size) for _, size in totals}
    rows = [(lang, size, langs.index(lang), most[size] / (A * n)) for (lang, size), n in totals.items()]
    # As an Arrow table: rows of a list pass through Python workers, for which each executor starts a second daemon that stays.
    columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
    scale = counts.sparkSession.createDataFrame(pa.Table.from_batches([as_batch(columns, [pa.string(), pa.int32(), pa.int32(), pa.float64()], ["lang", "size", "l", "scale"])]))
    each = counts.join(F.broadcast(scale), ["lang", "size"])  # a row for each language and order
    return stored(each.groupBy("gram").agg(F.sum("n").alias("n"), F.collect_list(F.struct("l", F.log1p(F.col("n") * F.col("scale")).cast("float").alias("s"))).alias("entries")), name)


def fit(training: DataFrame, most_words: int = MOST_WORDS) -> Model:
    """A model from (text, lang) rows; rows with a null in either are left out.  No rows: a model without languages.

    The driver receives the totals of languages and orders and, of words, most_words at most.
    """
    rows = training.select("text", "lang").where("text is not null and lang is not null")
    words = stored(rows.mapInArrow(_count_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    by_word, by_gram = _scored(words.withColumn("size", F.lit(0)), langs, "langid-word-scores"), _scored(_all_grams(words), langs, "langid-gram-scores")
    discard(words)
    # The count from which on words fit: eight steps to each doubling of it.
    step = F.floor(F.log2("n") * 8)
    most, from_ = min(most_words, MOST_CELLS // max(1, len(langs))), None
    for r in by_word.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        most -= r.k
        if most < 0:
            break
        from_ = r.step
    row: dict[str, int] = {}
    table = np.zeros((0, len(langs)), np.float32)
    if from_ is not None:
        got = by_word.where(step >= from_).select("gram", F.transform("entries", lambda e: e["l"]).alias("l"), F.transform("entries", lambda e: e["s"]).alias("s")).toArrow()
        row = {w: i for i, w in enumerate(got["gram"].to_pylist())}
        table = np.zeros((len(row), len(langs)), np.float32)
        l, s = (got[x].combine_chunks() for x in "ls")
        table[np.repeat(np.arange(len(row)), l.value_lengths().to_numpy(zero_copy_only=False)), l.flatten().to_numpy()] = s.flatten().to_numpy()
    return Model(langs, by_word, by_gram, row, table)


def _left(asked: DataFrame, model: Model) -> DataFrame:
    """(word, known, entries) of words: known if a language has the word, or a run of 4 or 5 of its letters, blanks around it among them."""
    found = stored(asked.join(model.words.select(F.col("gram").alias("word"), "entries"), "word", "left"), "langid-asked")
    out = found.where("entries is not null").select("word", F.lit(True).alias("known"), "entries")
    unseen = found.where("entries is null").select("word")
    for n in ORDERS:
        if unseen.isEmpty():
            break

        def split(batches, n=n):
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    own = [(w, g) for w in b.column(0).slice(at, 4096).to_pylist() for g in grams(w, n)]
                    for i in range(0, len(own), 50_000):
                        yield as_batch([list(x) for x in zip(*own[i : i + 50_000], strict=True)], [pa.string(), pa.string()], ["word", "gram"])

        hit = unseen.mapInArrow(split, "word string, gram string").join(model.grams.where(F.length("gram") == n).select("gram", "entries"), "gram")
        # The mean over the n-grams found.
        k = hit.select("word", F.explode(F.concat("entries", F.array(F.struct(F.lit(-1).alias("l"), F.lit(1.0).alias("s"))))).alias("e"))
        sums = k.groupBy("word", "e.l").agg(F.sum("e.s").alias("s"))
        scored = sums.groupBy("word").agg(F.max(F.when(F.col("l") < 0, F.col("s"))).alias("k"), F.collect_list(F.when(F.col("l") >= 0, F.struct("l", "s"))).alias("entries"))
        scored = stored(scored.select("word", F.transform("entries", lambda e: F.struct(e["l"].alias("l"), (e["s"] / F.col("k")).cast("float").alias("s"))).alias("entries")), "langid-backoff")
        out = out.unionByName(scored.select("word", F.lit(n >= 4).alias("known"), "entries"))
        unseen = unseen.join(scored, "word", "left_anti")
    return out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with text_key (SHA-256 of the text), lang_pred, lang_score and lang_known, the share of words that some language knows.

    A null text or one without a letter: `und` and 0.  Columns of docs with these names are replaced.  Rows are scored by their
    texts, so equal texts have equal scores, whatever the other columns are.
    """
    added = {"text_key", "lang_pred", "lang_score", "lang_known"}
    others = [c for c in docs.columns if c != text and c not in added]
    renamed = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(others)], text_key(text).alias("key"), F.col(text).alias("text"))
    fields = renamed.schema.fields[:-1]
    shared = docs.sparkSession.sparkContext.broadcast((model.row, model.table))
    own = [("sums", T.BinaryType(), pa.binary()), ("n", T.LongType(), pa.int64()), ("known", T.LongType(), pa.int64()), ("words", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("times", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]

    def run(batches):
        row, table = shared.value
        for b in drained(batches):
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                out = []
                for x in piece.column(piece.num_columns - 1).to_pylist():
                    words = words_of(x) if x else []
                    place = np.fromiter(map(row.get, words, repeat(-1)), np.int32, len(words))
                    inside = place >= 0
                    rest = {} if inside.all() else Counter(compress(words, ~inside))
                    out.append((table[place[inside]].sum(0, dtype=np.float64).tobytes(), len(words), int(inside.sum()), list(rest) or None, list(rest.values()) or None))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *[pa.array(c, t) for c, (_, _, t) in zip(zip(*out, strict=True), own, strict=True)]], [*piece.schema.names[:-1], *[name for name, *_ in own]])

    first = stored(renamed.mapInArrow(run, T.StructType([*fields, *[T.StructField(name, t) for name, t, _ in own]])), "langid-first")
    shared.destroy()  # workers let go of the words sent
    # Words that are left, once for each text however often that is repeated.  Texts get numbers, as their hashes would fill disks.
    left = first.where("words is not null").groupBy("key").agg(F.first(F.arrays_zip("words", "times")).alias("w"))
    left = stored(left.withColumn("t", F.monotonically_increasing_id()), "langid-rest")
    # What is carried on has no words.
    held, first = first, stored(first.select(*[f.name for f in fields], "sums", "n", "known", F.col("words").isNotNull().alias("partly")), "langid-first")
    discard(held)
    pairs = left.select("t", F.explode("w").alias("w")).select("t", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    looked_up = _left(pairs.select("word").distinct(), model)
    each = F.explode(F.concat("entries", F.array(F.struct(F.lit(-1).alias("l"), F.col("known").cast("float").alias("s"))))).alias("e")
    told = pairs.join(looked_up, "word").select("t", "times", each)
    sums = told.groupBy("t", "e.l").agg(F.sum(F.col("times") * F.col("e.s").cast("double")).alias("s"))
    rest = stored(sums.groupBy("t").agg(F.collect_list("l").alias("l"), F.collect_list("s").alias("s")).join(left.select("t", "key"), "t").drop("t"), "langid-sums")
    discard(left)
    langs = model.langs
    result = [("lang_pred", T.StringType(), pa.string()), ("lang_score", T.DoubleType(), pa.float64()), ("lang_known", T.DoubleType(), pa.float64())]

    def decide(batches):
        for b in batches:
            k = b.num_columns - 5
            out = []
            for total, n, known, l, s in zip(*(b.column(i).to_pylist() for i in range(k, k + 5)), strict=True):
                if not n or not langs:
                    out.append(("und", 0.0, 0.0))
                    continue
                total = np.frombuffer(total, np.float64).copy()
                for i, x in zip(l or (), s or (), strict=True):
                    if i < 0:
                        known += x
                    else:
                        total[i] += x
                best = int(np.argmax(total))
                out.append((langs[best], float(1 / np.exp(total - total[best]).sum()), known / n))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *[pa.array(c, t) for c, (_, _, t) in zip(zip(*out, strict=True), result, strict=True)]], [*b.schema.names[:k], *[name for name, *_ in result]])

    kept = [f.name for f in fields]
    whole = first.where("not partly").select(*kept, "sums", "n", "known", F.lit(None).cast("array<int>").alias("l"), F.lit(None).cast("array<double>").alias("s"))
    partly = first.where("partly").join(rest, "key", "left").select(*kept, "sums", "n", "known", "l", "s")
    done = whole.unionByName(partly).mapInArrow(decide, T.StructType([*fields, *[T.StructField(name, t) for name, t, _ in result]]))
    return done.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(others)], F.col("key").alias("text_key"), "lang_pred", "lang_score", "lang_known")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_known added, as `scored` has them; texts are dealt by their hash once."""
    docs = docs.drop("lang_pred", "lang_score", "lang_known")
    by_text = scored(docs.select(F.col(text).alias("text")).where("text is not null"), model).groupBy("text_key").agg(F.first("lang_pred").alias("lang_pred"), F.first("lang_score").alias("lang_score"), F.first("lang_known").alias("lang_known"))
    key = text_key(text)
    joined = docs.join(by_text, key == by_text["text_key"], "left")
    return joined.select(*[docs[c] for c in docs.columns], *[F.coalesce(by_text[c], F.lit(v)).alias(c) for c, v in (("lang_pred", "und"), ("lang_score", 0.0), ("lang_known", 0.0))])


def accepted(docs: DataFrame, model: Model, least_score: float, least_known: float, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs without those whose text is null, has no letter, or is under either of the two; columns and texts as they were."""
    judged = scored(docs.select("text").where("text is not null"), model)
    bad = stored(judged.where((F.col("lang_pred") == "und") | (F.col("lang_score") < least_score) | (F.col("lang_known") < least_known)).select("text_key").distinct(), "rejected")
    key = text_key("text")
    bad_ = F.broadcast(bad) if small_enough(bad, most_broadcast) else bad
    return docs.where("text is not null").join(bad_, key == bad_["text_key"], "left_anti").select(docs.columns)
