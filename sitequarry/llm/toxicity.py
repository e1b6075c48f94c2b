"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams, each hashed to a bucket
with an embedding; a text is the average of its words, each weighted
by the root of its count, 4 at most, so that a word said without end doesn't decide; a linear softmax over two
classes reads the average.  Embeddings and softmax are trained jointly in numpy.
A misspelt word that training never saw still shares most n-gram vectors with
the word it stands for.

The classifier is fitted on a bounded sample of labelled rows (`most_rows`,
chosen by a hash of the id); every text is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitequarry.llm.common import as_batch

WORD = re.compile(r"[^\W\d_]+")
U = np.uint64
BUCKETS = 1 << 17
SIZES = (3, 4, 5)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words themselves and of their character n-grams, as often as they occur, and which word each is of; of all words at once."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in marked), np.int64, len(words))]
    owners = [np.arange(len(words))]
    for n in SIZES:
        first = np.flatnonzero(np.arange(len(codes)) + n <= ends[owner])
        h = np.full(len(first), n, U)
        for j in range(n):
            h = (h ^ codes[first + j]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(32)
        buckets.append((h % U(BUCKETS)).astype(np.int64))
        owners.append(owner[first])
    return np.concatenate(buckets), np.concatenate(owners)


class Sample:
    """Word counts of texts as rows (text, word, count), words as numbers."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, count: np.ndarray, words: list[str], labels: np.ndarray):
        self.words, self.labels = words, labels.astype(np.float32)
        self.doc, self.word = doc.astype(np.int32), word.astype(np.int32)
        self.df = np.bincount(self.word, minlength=len(words))
        self.rarity = rarities(self.df, len(labels))
        w = np.minimum(4.0, np.sqrt(count)) * self.rarity[self.word]
        self.share = (SCALE * w / (PAD + np.bincount(self.doc, w, len(labels)))[self.doc]).astype(np.float32)

    @classmethod
    def of(cls, bags: list[Counter], labels: list[int]) -> Sample:
        words = sorted({w for b in bags for w in b})
        at = {w: i for i, w in enumerate(words)}
        rows = [(i, at[w], n) for i, b in enumerate(bags) for w, n in b.items()]
        return cls(*np.array(rows, np.int64).reshape(-1, 3).T, words, np.array(labels))


def rarities(df: np.ndarray, n: int, common: float = 0.005) -> np.ndarray:
    """Weights under 1 for words in over that share of the texts, falling with the log of the share; all others weigh 1."""
    return np.where(df > max(3, common * n), np.maximum(0.02, -np.log(np.maximum(df, 1) / max(n, 1)) / -math.log(common)), 1.0)


class _Batch:
    """Some texts of the sample, laid out for sums by text, word and bucket."""

    def __init__(self, sample: Sample, rows: np.ndarray, number: np.ndarray, parts: list):
        """rows: those of the sample; number: of each text its number in the batch or -1; parts: the buckets of each word, None for words that don't teach."""
        words, self.word = np.unique(sample.word[rows], return_inverse=True)
        sizes = np.array([len(parts[w]) for w in words])
        self.inverse = (1 / sizes).astype(np.float32)[:, None]
        self.used, flat = np.unique(np.concatenate([parts[w] for w in words]), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        by_bucket = np.argsort(self.flat, kind="stable")
        self.bucket_starts = np.searchsorted(self.flat[by_bucket], np.arange(len(self.used)))
        self.word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)[by_bucket]
        self.doc, self.share = number[sample.doc[rows]], sample.share[rows][:, None]
        self.by_word = np.argsort(self.word, kind="stable").astype(np.int32)
        self.word_starts = np.searchsorted(self.word[self.by_word], np.arange(len(words)))
        self.doc_ids, self.doc_starts = np.unique(self.doc, return_index=True)
        labels = sample.labels[number >= 0]
        self.target = np.stack([1 - labels, labels], 1)

    def gradients(self, p: dict, decay: float) -> dict:
        e = p["e"][self.used]
        words = np.add.reduceat(e[self.flat], self.starts) * self.inverse
        texts = np.zeros((len(self.target), e.shape[1]), np.float32)
        texts[self.doc_ids] = np.add.reduceat(words[self.word] * self.share, self.doc_starts)
        z = texts @ p["u"] + p["b"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        d = (q - self.target) / len(self.target)
        d_words = np.add.reduceat(((d @ p["u"].T)[self.doc] * self.share)[self.by_word], self.word_starts) * self.inverse
        return {"u": texts.T @ d, "b": d.sum(0), "e": np.add.reduceat(d_words[self.word_of], self.bucket_starts) + decay * e}


def train(sample: Sample, dim: int = 4, epochs: int = 16, batches: int = 16, rate: float = 0.2, decay: float = 1e-6, adapt: float = 0.25, seed: int = 7, least_docs: int = 2) -> dict:
    """Momentum with partly adapted steps over a fixed division of the sample.

    Words in fewer than least_docs texts teach nothing themselves; their n-grams occur elsewhere.  The model keeps one
    number for each bucket: its share of the difference of the two softmax inputs.  A sample without either of the
    two labels gives a model that answers the label it has, and not toxic if it is empty.
    """
    y, n = sample.labels, len(sample.labels)
    known = np.unique(sample.doc[sample.df[sample.word] >= least_docs])
    if not n or y.min() == y.max() or not len(known):
        return {"bucket": np.zeros(BUCKETS, np.float32), "bias": float(4 if n and y.min() == 1 else -4), "rarity": {}}
    taught = np.flatnonzero(sample.df >= least_docs)
    parts: list = [None] * len(sample.words)
    for at in range(0, len(taught), 4096):
        some = taught[at : at + 4096]
        buckets, owner = subwords([sample.words[i] for i in some])
        order = np.argsort(owner, kind="stable")
        for i, own in zip(some, np.split(buckets[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(some)))[:-1]), strict=True):
            parts[i] = own
    rng = np.random.default_rng(seed)
    order = rng.permutation(known)
    batches = max(1, min(batches, len(order) // 32))
    made = []
    for k in range(batches):
        number = np.full(n, -1, np.int32)
        own = np.sort(order[k::batches])
        number[own] = np.arange(len(own), dtype=np.int32)
        made.append(_Batch(sample, np.flatnonzero((number[sample.doc] >= 0) & (sample.df[sample.word] >= least_docs)), number, parts))
    del parts
    p = {"e": rng.normal(0, 0.02, (BUCKETS, dim)).astype(np.float32), "u": rng.normal(0, 0.5, (dim, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    trained = np.zeros(BUCKETS, bool)
    steps = max(epochs * batches, 60)
    for step in range(1, steps + 1):
        own = made[step % batches]
        g = own.gradients(p, decay)
        now = rate * (1 - step / steps) + rate / 20
        for k in p:
            at = own.used if k == "e" else slice(None)
            m[k][at] += 0.1 * (g[k] - m[k][at])
            s[k][at] += 0.01 * (g[k] ** 2 - s[k][at])
            v = s[k][at] / (1 - 0.99**step)
            p[k][at] -= now * (m[k][at] / (1 - 0.9**step)) / (v ** (adapt / 2) * v.mean() ** ((1 - adapt) / 2) + 1e-12)
        trained[own.used] = True
    out = np.where(trained, SCALE * (p["e"] @ (p["u"][:, 1] - p["u"][:, 0])), 0).astype(np.float32)
    return {"bucket": out, "bias": float(p["b"][1] - p["b"][0]), "rarity": {sample.words[i]: float(sample.rarity[i]) for i in np.flatnonzero(sample.rarity < 1)}}


#: What an average is multiplied by before the softmax: a text's few telling words weigh little in its average.
SCALE = 20.0
#: Neutral words (of value 0) that every average holds besides the text's own: a text of few words decides less.
PAD = 30.0


class Scorer:
    """Scores texts; a word leads to its place in an array of values (its share of the logit) and rarities.  Remembers about `most` words beside those of one call."""

    def __init__(self, model: dict, most: int = 300_000):
        self.bucket, self.bias, self.rarity, self.most = model["bucket"].astype(np.float64), model["bias"], model["rarity"], most
        self.row: dict[str, int] = {}
        self.values = np.zeros((0, 2))

    def _learn(self, words: list[str]) -> None:
        made = np.ones((len(words), 2))
        for at in range(0, len(words), 4096):
            buckets, owner = subwords(words[at : at + 4096])
            made[at : at + 4096, 0] = np.bincount(owner, self.bucket[buckets]) / np.bincount(owner)
        made[:, 1] = [self.rarity.get(w, 1.0) for w in words]
        self.row.update(zip(words, range(len(self.row), len(self.row) + len(words)), strict=True))
        self.values = np.concatenate([self.values, made])

    def scores(self, texts: list[str | None]) -> list[float]:
        bags = [Counter(WORD.findall(x.lower())) if x else Counter() for x in texts]
        if len(self.row) > self.most:
            self.row, self.values = {}, np.zeros((0, 2))
        if unseen := list(dict.fromkeys(w for bag in bags for w in bag if w not in self.row)):
            self._learn(unseen)
        out = []
        for bag in bags:
            z = self.bias
            if n := len(bag):
                value, rarity = self.values[np.fromiter(map(self.row.__getitem__, bag), np.int64, n)].T
                weights = np.minimum(4.0, np.sqrt(np.fromiter(bag.values(), np.float64, n))) * rarity
                z += float(weights @ value) / (PAD + float(weights.sum()))
            out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def fit(labelled: DataFrame, most_rows: int = 8_000) -> dict:
    """A model from rows (doc_id, text, toxic); rows with a null label are left out, a null text is an empty one.

    The driver receives the word counts of about most_rows rows, chosen by a hash of doc_id.
    """
    rows = labelled.where("toxic is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(1_000_003 * most_rows / n))

    def bag(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, texts, labels = (c.to_pylist() for c in b.slice(at, 256).columns)
                counts = [Counter(WORD.findall(t.lower())) for t in texts]
                yield as_batch([ids, [list(c) for c in counts], [list(c.values()) for c in counts], labels], [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32()], ["doc_id", "words", "counts", "toxic"])

    got = rows.mapInArrow(bag, "doc_id long, words array<string>, counts array<int>, toxic int").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    words = got["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(got.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
    sample = Sample(doc, coded.indices.to_numpy(), got["counts"].combine_chunks().flatten().to_numpy(), coded.dictionary.to_pylist(), got["toxic"].to_numpy())
    del got, words, coded, doc
    return train(sample)


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) added; a text that is null or has no word gets the score of the bias alone.  A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("toxicity")
    place = kept.columns.index(text)

    def run(batches):
        model = shared.value
        scorer = model.setdefault("scorer", None) or Scorer(model)
        model["scorer"] = scorer  # lives as long as the worker has the broadcast
        for b in batches:
            for at in range(0, b.num_rows, 128):
                piece = b.slice(at, 128)
                got = scorer.scores(piece.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(got, pa.float64())], [*piece.schema.names, "toxicity"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DoubleType())]))
