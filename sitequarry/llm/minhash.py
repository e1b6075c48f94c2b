"""Near-duplicate documents by MinHash.

Each distinct shingle set gets minima of many universal hashes; bands of minima
name candidate pairs; a pair is verified by its signatures and then on the full
sets; the verified links are joined to components.

Pairs: within a band's bucket every set is first compared with the bucket's
least and greatest member only.  Where a bucket then still holds sets of different
components, more is compared, so that no link is lost that the bands have found:
in buckets of up to SMALL sets each two of different components; larger ones are joined to
clusters, and each cluster is searched by differences from one centre (see _apart),
so that a large group never costs all its pairs.  At similarity 0.8, 32 bands of 4
minima miss a pair with probability (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.llm.bytescan import U, mix, shingle_sets, slices
from sitequarry.llm.common import as_batch, discard, drained, light_enough, small_enough, stored
from sitequarry.llm.components import components

BANDS, ROWS = 32, 4
#: A signature agreement lower by this much than the threshold rules a pair out: over six standard deviations of 128 minima at 0.8.
MARGIN = 0.22
#: Buckets of more sets than that are searched by differences.
SMALL = 12
#: Of each centre so many of its most frequent differences are put last in the order of all; the others stand in the order of their hashes.
FREQUENT = 999
#: Bytes of centres' sets, or of their frequent differences, that are broadcast at most.
MOST_BYTES = 64 << 20


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


A, B = _coefficients(BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima, 32 bits each, of multiply-shift hashes."""
    out = np.full(len(A), 2**64 - 1, U)
    for at in range(0, len(shingles), 1024):
        out = np.minimum(out, (A[:, None] * shingles[at : at + 1024] + B[:, None]).min(axis=1))
    return (out >> U(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """Hashes of the bands of signatures (rows)."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15), s.shape[:2])
    for i in range(ROWS):
        h = mix(h + s[:, :, i] * U(0xC2B2AE3D27D4EB4F))
    return h.view(np.int64)


def _texts(column: pa.Array):
    """(first row, texts as UTF-8) in slices of bounded size."""
    sizes = pc.binary_length(column).to_pylist()
    binary = column.cast(pa.binary())
    for a, b in slices(sizes):
        yield a, binary.slice(a, b - a).to_pylist()


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig) of each document; h1 and h2 together stand for the set; an empty set has a null sig."""

    def run(batches):
        for batch in drained(batches):
            for at, texts in _texts(batch.column(1)):
                n, h1, h2, sig = [], [], [], []
                for s in shingle_sets(texts, words):
                    n.append(len(s))
                    h1.append(int(s.sum(dtype=U).view(np.int64)) if len(s) else 0)
                    h2.append(int(mix(s).sum(dtype=U).view(np.int64)) if len(s) else 0)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield as_batch([batch.column(0).slice(at, len(n)), n, h1, h2, sig], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _banded(reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                sig = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint32).reshape(piece.num_rows, -1)
                ids = np.repeat(piece.column(0).to_numpy(), BANDS)
                yield as_batch([bands(sig).ravel(), ids], [pa.int64(), pa.int64()], ["band", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(run, "band long, doc_id long")


def _alike(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures don't rule the threshold out."""
    own = reps.select("doc_id", "sig", "n_shingles")
    both = pairs.join(own.toDF("a", "sig_a", "n_a"), "a").join(own.toDF("b", "sig_b", "n_b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                p = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(p.column(i).to_pylist()), np.uint32).reshape(p.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(axis=1) >= threshold - MARGIN)
                yield as_batch([p.column(0).filter(keep), p.column(1).filter(keep)], [pa.int64(), pa.int64()], ["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, most_broadcast: int) -> DataFrame:
    """(doc_id, shingles) of the documents wanted: their whole sets, sorted, 8 bytes a shingle."""
    wanted = wanted.distinct()
    wanted = F.broadcast(wanted) if small_enough(wanted, most_broadcast) else wanted

    def sets(batches):
        for batch in drained(batches):
            for at, texts in _texts(batch.column(1)):
                found = shingle_sets(texts, words)
                yield as_batch([batch.column(0).slice(at, len(found)), [s.tobytes() for s in found]], [pa.int64(), pa.binary()], ["doc_id", "shingles"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: float, most_broadcast: int) -> DataFrame:
    """Those of the pairs that reach the threshold on their full sets."""
    pairs = stored(pairs, "pairs")
    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                p = batch.slice(at, 64)
                keep = []
                for x, y in zip(p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                    merged = np.concatenate([x, y])
                    merged.sort()
                    common = int((merged[1:] == merged[:-1]).sum())
                    keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
                keep = pa.array(keep, pa.bool_())
                yield as_batch([p.column(0).filter(keep), p.column(1).filter(keep)], [pa.int64(), pa.int64()], ["a", "b"])

    full = _sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), words, most_broadcast)
    return pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _differences(batches):
    """(centre, doc_id, added, lost, n, n_c) of (centre, doc_id, set, set of the centre): shingles, sorted, that only the one or the other has."""
    names, types = ["centre", "doc_id", "added", "lost", "n", "n_c"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            p, out = batch.slice(at, 64), []
            for c_id, doc_id, x, c in zip(*(p.column(i).to_pylist() for i in range(4)), strict=True):
                x, c = np.frombuffer(x, U), np.frombuffer(c, U)
                out.append((c_id, doc_id, np.setdiff1d(x, c, assume_unique=True).tobytes(), np.setdiff1d(c, x, assume_unique=True).tobytes(), len(x), len(c)))
            yield as_batch([list(x) for x in zip(*out, strict=True)], types, names)


def _occurrences(batches):
    """(centre, element, n) of (centre, added, lost), summed over some rows of a centre before they are dealt."""

    def told(centre, held):
        element, n = np.unique(np.concatenate(held), return_counts=True)
        return as_batch([np.full(len(element), centre), element.view(np.int64), n], [pa.int64(), pa.int64(), pa.int64()], ["centre", "element", "n"])

    for batch in batches:
        sums: dict[int, list] = {}
        size = 0
        for centre, added, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums.setdefault(centre, []).append(np.concatenate([np.frombuffer(added, U), np.frombuffer(lost, U)]))
            size += len(added) + len(lost)
            if size > 8 << 20:
                yield from (told(c, held) for c, held in sums.items())
                sums, size = {}, 0
        yield from (told(c, held) for c, held in sums.items())


def _apart(large: DataFrame, docs: DataFrame, words: int, threshold: float, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Of large buckets (band, doc_id, low): the links to the centres of their clusters, and the pairs that remain to be verified.

    Let A(x) be the shingles that x has and the centre c has not, R(x) those of c that x lacks, D(x) both together, and
    q = (1 - t) / (1 + t).  x and y are linked if and only if |x D y| <= q (|x| + |y|), and |x D y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|.
    If x isn't linked to c, so that e = |D(x)| - q (|x| + |c|) > 0, it follows that D(x) and D(y) have more than
    (1 - q) / 2 |D(y)| and at least e / (1 + q) shingles in common.  Two sets that have k elements in common have the first of
    them, in any order, among their first |set| - k + 1.  Here A comes before R; within them come the shingles that are not in the
    centre's table of frequent ones, by hash, and then those of the table, the rarest first.  The table is bounded
    (FREQUENT), which costs work where it doesn't reach and never a pair: any order will do that is the same for all of a centre.
    Where the table has all that occur twice, what isn't in it is only counted, as one document alone has it.
    If none of A is in common, x and y meet in what is left of c, at most in |x & c|, which is too little unless y is smaller than
    c by g = |x| + |c| - (1 + t) / t |x & c| > 0 at least.  So pairs come from a common element of A or, for such y, of R.
    If both are linked to c, they are in one component anyway.

    A bucket's centre is its set that is in most large buckets: one that is like most others.  Buckets with the same centre are one
    cluster, so a group of near copies is searched once, not once for each band.
    """
    q = (1 - threshold) / (1 + threshold)
    counted = large.groupBy("doc_id").agg(F.count("*").alias("n"))
    centre = large.select("band", "doc_id").join(counted, "doc_id").groupBy("band").agg(F.max_by("doc_id", F.struct("n", (-F.col("doc_id")).alias("o"))).alias("centre"))
    member = stored(large.select("band", "doc_id").join(centre, "band").select("centre", "doc_id").distinct(), "clusters")
    full = _sets(docs, member.select("doc_id"), words, most_broadcast)
    middle = member.select("centre").distinct().join(full.toDF("centre", "c"), "centre").select("centre", "c")
    middle = F.broadcast(middle) if most_broadcast and light_enough(middle, F.octet_length("c"), MOST_BYTES) else middle
    own = member.join(full, "doc_id").join(middle, "centre").select("centre", "doc_id", "shingles", "c")
    d = stored(own.mapInArrow(_differences, "centre long, doc_id long, added binary, lost binary, n long, n_c long"), "differences")
    discard(member, full)
    excess = (F.octet_length("added") + F.octet_length("lost")) / 8 - q * (F.col("n") + F.col("n_c"))
    central = d.where((excess <= 1e-9) & (F.col("doc_id") != F.col("centre"))).select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    times = d.select("centre", "added", "lost").mapInArrow(_occurrences, "centre long, element long, n long").groupBy("centre", "element").agg(F.sum("n").alias("n")).where("n > 1")
    turn = F.row_number().over(W.partitionBy("centre").orderBy(F.col("n").desc(), "element"))
    table = times.withColumn("turn", turn).where(F.col("turn") <= FREQUENT + 1).groupBy("centre").agg(F.collect_list(F.struct("turn", "element")).alias("frequent"))
    # Of a centre at most FREQUENT + 1 numbers; a table of so many isn't complete.
    table = stored(table.select("centre", F.expr(f"transform(array_sort(filter(frequent, x -> x.turn <= {FREQUENT})), x -> x.element)").alias("frequent"), (F.size("frequent") <= FREQUENT).alias("complete")), "frequent")
    table = F.broadcast(table) if most_broadcast and light_enough(table, 8 * F.size("frequent"), MOST_BYTES) else table

    def prefixes(batches):
        names = ["centre", "element", "added", "doc_id", "n", "size", "place", "linked", "gap", "smaller", "short"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for c_id, doc_id, added, lost, n, n_c, frequent, complete in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    known = np.array(frequent or [], np.int64).view(U)  # the most frequent first
                    by_hash = np.argsort(known)
                    size, gained = (len(added) + len(lost)) // 8, len(added) // 8
                    over = size - q * (n + n_c)
                    gap, common = n + n_c - (1 + threshold) / threshold * (n - gained), max(1, int(np.ceil(over / (1 + q) - 1e-9)))
                    low, linked = size - int((1 - q) / 2 * size + 1e-9), over <= 1e-9
                    far = low if linked else max(low, size - common + 1)
                    before = 0
                    for part, is_added in ((added, True), (lost, False)):
                        x = np.frombuffer(part, U)
                        turn = np.full(len(x), len(known) + 1)
                        if len(known):
                            hit = np.minimum(np.searchsorted(known, x, sorter=by_hash), len(known) - 1)
                            same = known[by_hash[hit]] == x
                            turn[same] = by_hash[hit[same]]
                        order = np.lexsort((x, -turn))
                        place = np.arange(before + 1, before + len(x) + 1)
                        before += len(x)
                        keep = (place <= far) & ~(complete & (turn[order] > len(known)))
                        element, place = x[order][keep], place[keep]
                        m = len(element)
                        out.append((np.full(m, c_id), element.view(np.int64), np.full(m, is_added), np.full(m, doc_id), np.full(m, n), np.full(m, size), place, np.full(m, linked), np.full(m, gap), np.full(m, n_c - n), place <= low))
                yield as_batch([np.concatenate(x) for x in zip(*out, strict=True)], types, names)

    ranked = d.join(table, "centre", "left").select("centre", "doc_id", "added", "lost", "n", "n_c", "frequent", F.coalesce("complete", F.lit(True)).alias("complete"))
    ranked = stored(ranked.mapInArrow(prefixes, "centre long, element long, added boolean, doc_id long, n long, size long, place long, linked boolean, gap double, smaller long, short boolean"), "prefixes")
    x, y = (ranked.select("centre", "element", "added", *[F.col(n).alias(f"{n}_{k}") for n in ("doc_id", "n", "size", "place", "linked", "gap", "smaller", "short")]) for k in "xy")
    # Sizes alone rule out most: those of the sets, and those of the differences, of which no more than the smaller is in common.
    # So does the place of the first common element: from there on, either set must hold as many as a link needs in common.
    needed = f"((size_x + size_y - {q} * (n_x + n_y)) / 2 - 1e-9)"
    sizes = f"least(n_x, n_y) >= {threshold} * greatest(n_x, n_y) - 1e-9 and size_x - place_x + 1 >= {needed} and size_y - place_y + 1 >= {needed}"
    ordered = f"doc_id_x <> doc_id_y and (linked_y or (short_x and doc_id_x < doc_id_y)) and {sizes}"
    same = ["centre", "element", "added"]
    gained = x.where("added and not linked_x").join(y.where("added and short_y"), same).where(ordered)
    fits = "smaller_y >= gap_x - 1e-9 and (linked_y or smaller_x >= gap_y - 1e-9)"
    lost = x.where("not added and not linked_x").join(y.where("not added and short_y and smaller_y > 0"), same).where(f"{ordered} and {fits}")
    met = gained.unionByName(lost).select(F.col("doc_id_x").alias("x"), F.col("doc_id_y").alias("y"))
    return central, met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, most_broadcast: int = 2_000_000) -> DataFrame:
    """Per document doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets have at least that Jaccard similarity; component_id is the smallest doc_id
    reachable over links.  Lower case is for A-Z only, words are runs without white space; fewer words than a shingle
    has make one shingle; a null text, or one without words, is linked with nothing.  doc_id is expected to be
    unique and not null: repeated rows of one doc_id and text give repeated rows, of one doc_id and different texts count as one
    document with either text, and a null doc_id is a component of its own.
    """
    all_ = stored(signed(docs, words), "signed")
    some = all_.where("n_shingles > 0 and doc_id is not null")
    # Documents with the same set are one class, under its least id.
    classes = stored(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.count("*").alias("n")), "classes")
    reps = classes.select("doc_id", "sig", "n_shingles")
    banded = _banded(reps)
    buckets = banded.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    members = stored(banded.join(buckets, "band"), "members")
    ends = members.selectExpr("explode(array(struct(low as a, doc_id as b), struct(doc_id as a, high as b))) as p").select("p.*").where("a < b").distinct()
    links = stored(_verified(_alike(ends, reps, threshold), docs, words, threshold, most_broadcast), "links")
    first = found = components(links)
    # Buckets that still hold sets of different components.
    placed = members.select("band", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.min("doc_id").alias("low")).where("x < y").select("band", "n", "low")
    placed = stored(placed.join(open_, "band"), "open")
    left, right = (placed.where(F.col("n") <= SMALL).select("band", F.col("doc_id").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    rest = left.join(right, "band").where("a < b and ca <> cb").select("a", "b").distinct().join(ends, ["a", "b"], "left_anti")
    more = _verified(_alike(rest, reps, threshold), docs, words, threshold, most_broadcast)
    large = placed.where(F.col("n") > SMALL)
    if not large.isEmpty():
        central, apart = _apart(large, docs, words, threshold, most_broadcast)
        more = more.unionByName(central).unionByName(_verified(_alike(apart.join(ends, ["a", "b"], "left_anti"), reps, threshold), docs, words, threshold, most_broadcast))
    more = stored(more, "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
        discard(first)
    discard(members, links, placed, more)
    label = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    joined = all_.drop("sig").join(label, ["h1", "h2", "n_shingles"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, threshold: float = 0.8, most_broadcast: int = 2_000_000) -> DataFrame:
    """docs with one document of each group of near duplicates, that of least doc_id; columns and texts as they were.

    Of rows with one doc_id one stays; rows with a null doc_id all stay.
    """
    gone = stored(near_duplicates(docs, words, threshold, most_broadcast).where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(F.broadcast(gone) if small_enough(gone, most_broadcast) else gone, "doc_id", "left_anti").select(docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return left
    twice = stored(twice, "twice")
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
