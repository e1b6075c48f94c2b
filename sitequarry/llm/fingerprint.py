"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines that are not blank).  Every
paragraph is hashed to a wide vector; a fingerprint is the sum of these vectors
modulo 2**16 per lane, so it doesn't depend on order, and paragraphs can be added
or taken away without the rest of the text.  The first half of the lanes comes
from a hash of the whole paragraph and serves equality.  The second half is a
signed sketch of the paragraph's sentences; being a sum as well, its inner
product estimates how much two texts share, which is the likeness.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import as_batch

LANES = 128
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def paragraph_vector(paragraph: str) -> np.ndarray:
    """LANES uniform lanes for the paragraph, LANES sketch lanes for its sentences."""
    out = np.empty(2 * LANES, np.uint16)
    out[:LANES] = np.frombuffer(hashlib.shake_128(paragraph.encode("utf-8", "surrogatepass")).digest(2 * LANES), np.uint16)
    said = [s for s in SENTENCE.split(paragraph) if s]
    h = np.frombuffer(b"".join(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest() for s in said), np.uint64)
    lane, sign = (h % np.uint64(LANES)).astype(np.int64), ((h >> np.uint64(63)).astype(np.int64) * 2 - 1)
    out[LANES:] = np.bincount(lane, sign, LANES).astype(np.int64).astype(np.uint16)
    return out


def paragraphs(text: str | None) -> list[str]:
    return [p for line in (text or "").split("\n") if (p := line.strip())]


class Vectors:
    """paragraph_vector with a memory of limited size: what edited texts share with their sources is hashed once."""

    def __init__(self, most: int = 4096):
        self.most, self.seen = most, {}

    def total(self, text: str | None) -> np.ndarray:
        out = np.zeros(2 * LANES, np.uint16)
        for p in paragraphs(text):
            v = self.seen.get(p)
            if v is None:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                v = self.seen[p] = paragraph_vector(p)
            out += v
        return out


def insert(fingerprint: str, paragraph: str) -> str:
    return encode(decode(fingerprint) + paragraph_vector(paragraph.strip()))


def delete(fingerprint: str, paragraph: str) -> str:
    return encode(decode(fingerprint) - paragraph_vector(paragraph.strip()))


def encode(vector: np.ndarray) -> str:
    return base64.b64encode(vector.astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u2").astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints; else the cosine of the sketch lanes, read as signed, not below 0."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[LANES:].astype(np.int16).astype(np.float64) for v in (a, b))
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(order, cuts: list[int]):
    """How many of the cuts, in rising order, are smaller: a binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: n + F.when((n + s <= len(cuts)) & (F.get(table, n + s - 1) < order), s).otherwise(0))


def fingerprints(docs: DataFrame, parts: int = 0) -> DataFrame:
    """One row per document: its fingerprint and that of its edited text, whose end comes from the next document.

    The next document is the one before it by doc_id (descending order); after the last comes the first.  A null
    text counts as empty; rows of one doc_id follow one another by a hash of the text, then the text; rows whose doc_id is null come
    last, in that order.  An only document is followed by itself.  An empty table gives no rows.  Other columns are not read.

    The order is made by ranges: quantiles of the ids, found on the driver, cut the ids into ranges (of some 64 MB of text,
    several for a task, 20,000 at most), every range is sorted in one task, and the first document of a range is sent to the
    range before it as well.  An id that fills several ranges, or null, is cut by the hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    size = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).head()
    if not size.n:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    parts = parts or min(20_000, max(16 * tasks, size.bytes >> 26))
    # Evenly spaced quantiles: at most `parts` numbers reach the driver.
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20_000).alias("c")).head().c if parts > 1 else None
    times = Counter(found or [])
    cuts = sorted(times)
    # Ids above the highest cut are range 0; ids from above the cut before to a cut are one range, or, where the cut itself fills
    # ranges, as many for it alone and one for the others.  A null id is in the last ranges.
    widths = [1] + [times[c] + 1 if times[c] > 1 else 1 for c in reversed(cuts)]
    starts = [sum(widths[:i]) for i in range(len(widths) + 1)]
    hash_ = F.shiftrightunsigned(F.xxhash64("text"), 33)

    def share(n):
        """0 to n - 1, falling with the hash."""
        return n - 1 - F.floor(hash_ * n / F.lit(1 << 31)).cast("int")

    at = F.lit(len(cuts)) - _range_of(F.col("doc_id"), cuts)
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    own = F.get(literal([0, *[times[c] for c in reversed(cuts)]]), at)
    cut = F.get(F.array(F.lit(None).cast("long"), *[F.lit(c).cast("long") for c in reversed(cuts)]), at)
    place = F.get(literal(starts), at) + F.when(own > 1, F.when(F.col("doc_id") == cut, share(own)).otherwise(own)).otherwise(0)
    nulls = max(1, round(parts * (size.n - size.ids) / size.n))
    place = F.when(F.col("doc_id").isNull(), F.lit(starts[-1]) + share(F.lit(nulls))).otherwise(place)
    placed = rows.withColumn("place", place.cast("int")).withColumn("hash", F.xxhash64("text"))
    # In a range rows fall by doc_id, then by the hash without its sign, as `share` does, then by the text.
    rank = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id"), F.shiftrightunsigned("hash", 1).alias("h"), F.col("hash"))
    # The first of each range: one row for each.
    first = {r.place: r.top for r in placed.groupBy("place").agg(F.max(rank).alias("top")).collect()}
    here = sorted(first)
    before = {p: here[i - 1] for i, p in enumerate(here)}
    tops = F.array(*[F.lit(first[p].doc_id if p in first else None).cast("long") for p in range(here[-1] + 1)])
    hashes = F.array(*[F.lit(first[p].hash if p in first else None).cast("long") for p in range(here[-1] + 1)])
    homes = F.array(*[F.lit(before.get(p)).cast("int") for p in range(here[-1] + 1)])
    is_first = F.col("doc_id").eqNullSafe(F.get(tops, F.col("place"))) & (F.col("hash") == F.get(hashes, F.col("place")))
    # Rows that tie for first are equal, up to the hash; all go, and the reader stops at the first.
    copies = placed.withColumn("sent", F.when(is_first, F.get(homes, F.col("place")))).withColumn("guest", F.explode(F.expr("case when sent is null then array(false) else array(false, true) end")))
    moved = copies.select(F.expr("case when guest then sent else place end").alias("place"), "guest", "doc_id", "hash", "text")
    ordered = moved.repartition(tasks, "place").sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(), F.shiftrightunsigned("hash", 1).desc(), F.col("hash").desc(), "text")
    return ordered.select("place", "guest", "doc_id", "text").mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _walk(batches):
    vectors = Vectors()
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = None  # (place, doc_id, text, vector) of a row whose follower hasn't come yet
    out: list = []

    def finish(row, text, vector):
        _, doc_id, own, print_ = row
        edited = edited_text(own, text)
        e = vectors.total(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(own), digest, encode(print_), encode(e), likeness(print_, e), likeness(print_, vector)

    for b in batches:
        for at in range(0, b.num_rows, 256):
            piece = b.slice(at, 256)
            for place, guest, doc_id, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if guest and (last is None or last[0] != place):
                    continue
                vector = vectors.total(text)
                if last is not None and last[0] == place:
                    out.append(finish(last, text, vector))
                last = None if guest else (place, doc_id, text, vector)
            if out:
                yield as_batch([list(x) for x in zip(*out, strict=True)], types, names)
                out = []
