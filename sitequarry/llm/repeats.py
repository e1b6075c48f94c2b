"""Repeated strings removed, exactly, by prefix-free parsing and suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in
this document or another.

Parse.  A rolling hash of WIDTH bytes picks triggers, so that any LENGTH bytes hold at
least one and equal bytes hold the same.  Triggers cut each text into phrases; a
phrase is the stretch in which all strings of LENGTH bytes have one trigger, so it
overlaps its neighbours by LENGTH - 1 bytes and no string is split.
Dictionary.  The distinct phrases, told apart by 128 bits of blake2b.  As a phrase holds its strings
whole, the parse needs ordering to a depth of one phrase only: occurrences of equal phrases are
neighbours there, and all their strings are repeated.  In highly repetitive text these are nearly all, and
they are never looked at again.  A phrase whose trigger occurs nowhere else holds no repeated string.
Suffix arrays.  Equal strings have equal triggers.  The phrases that remain are gathered by trigger, and the
suffix array of the dictionary's part that a task holds is made by prefix doubling on its bytes, to
the depth of LENGTH that the question needs.  Together with the order of triggers that is an order of the corpus:
suffixes by trigger, then by their bytes.  Neighbours in it that agree to that depth are repeated.
Beyond GROUP bytes of phrases of one trigger, the strings are dealt out one by one instead, by 128 bits of blake2b,
so a frequent line or passage never meets in one task.

Nothing is sampled, capped or dropped: triggers and phrases are counted over all documents, and all strings
that could be equal are compared.  The rolling hash only chooses places; bytes or blake2b decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.bytescan import U, slices, windows
from sitequarry.llm.common import as_batch, discard, stored

#: Bytes of phrases of one trigger that one row may hold.
GROUP = 4 << 20
#: Bytes of text whose hashes, or ranks, are held at once.
SLICE = 1 << 19

#: Strings of that many bytes are looked for; triggers are hashes of WIDTH bytes.
LENGTH, WIDTH = 200, 64
SPAN = LENGTH - WIDTH + 1
TOP = U(2**64 - 1)


def _sliding(values: np.ndarray, span: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `span` values that follow one another."""
    f, fill = (np.minimum, TOP) if least else (np.maximum, U(0))
    n = len(values)
    padded = np.full(-(-n // span) * span, fill, U)
    padded[:n] = values
    rows = padded.reshape(-1, span)
    ahead = f.accumulate(rows, axis=1).ravel()
    behind = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - span + 1], ahead[span - 1 : n])


def phrases(texts: list[bytes]):
    """The parse of texts: (text, first start, last start, trigger, again), one entry for each phrase.

    A phrase holds the strings that start at consecutive places and have the same trigger, which is the least
    hash of WIDTH bytes in them.  Equal strings have the same trigger at the same place, whatever stands around
    them.  again: two strings of the phrase may be equal.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH or not (sizes >= LENGTH).any():
        return empty, empty, empty, empty.view(U), np.empty(0, bool)
    h = windows(data, WIDTH)
    m = _sliding(h, SPAN, True)  # trigger of the string at each start
    start = np.arange(len(m))
    text = np.searchsorted(bounds, start, side="right") - 1
    valid = start + LENGTH <= bounds[text + 1]
    # Places that hold the trigger of some string, for ties.
    reach = np.zeros(len(m) + 2 * (SPAN - 1), U)
    reach[SPAN - 1 : SPAN - 1 + len(m)] = np.where(valid, m, U(0))
    places = np.flatnonzero(_sliding(reach, SPAN, False)[: len(h)] == h)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(m) - 1]])
    kept = valid[first]
    first, last = first[kept], last[kept]
    trigger = m[first]
    order = np.lexsort((places, h[places]))
    value, place = h[places][order], places[order]
    tied = np.unique(value[1:][(value[1:] == value[:-1]) & (place[1:] - place[:-1] < 2 * LENGTH)])
    again = np.isin(trigger, tied)
    owner = text[first]
    return owner, first - bounds[owner], last - bounds[owner], trigger, again


def digest(data: bytes) -> bytes:
    """What stands for bytes where they would take too much room."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _slices(column: pa.Array):
    binary = column.cast(pa.binary())
    for a, b in slices(pc.binary_length(binary).to_pylist(), SLICE):
        yield a, [t or b"" for t in binary.slice(a, b - a).to_pylist()]


def _count(batches):
    """(trigger, n, again) of texts, summed by slice."""
    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            _, _, _, trigger, again = phrases(texts)
            found, back, n = np.unique(trigger, return_inverse=True, return_counts=True)
            marked = np.zeros(len(found), bool)
            marked[back[again]] = True
            yield as_batch([found.view(np.int64), n, marked], [pa.int64(), pa.int64(), pa.bool_()], ["trigger", "n", "again"])


def _parse(batches):
    """(trigger, content, doc, tag, first, last, again) of (doc, tag, text)."""
    names = ["trigger", "content", "doc", "tag", "first", "last", "again"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in batches:
        doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, texts in _slices(batch.column(2)):
            owner, first, last, trigger, again = phrases(texts)
            for a in range(0, len(owner), 50_000):
                x = slice(a, a + 50_000)
                rows = owner[x] + at
                content = [digest(texts[i][f : l + LENGTH]) for i, f, l in zip(owner[x].tolist(), first[x].tolist(), last[x].tolist(), strict=True)]
                yield as_batch([trigger[x].view(np.int64), content, doc[rows], tag[rows], first[x].astype(np.int32), last[x].astype(np.int32), again[x]], types, names)


def _cut(batches):
    """The bytes of the phrases wanted of each document: (doc, tag, text, wanted) -> one row for each."""
    names = ["trigger", "many", "doc", "tag", "first", "single", "bytes"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in batches:
        docs, tags, wanted = (batch.column(i).to_pylist() for i in (0, 1, 3))
        texts = batch.column(2).cast(pa.binary())
        for i, want in enumerate(wanted):
            text = texts[i].as_py() or b""
            yield as_batch([[w["trigger"] for w in want], [w["many"] for w in want], [docs[i]] * len(want), [tags[i]] * len(want), [w["first"] for w in want], [w["single"] for w in want], [text[w["first"] : w["last"] + LENGTH] for w in want]], types, names)


def ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """The place of each suffix of data (bytes as uint8) in their order to that depth, 8 at least; equal suffixes have equal places.

    Prefix doubling: suffixes in the order of their first d bytes are put in that of 2 d by the places of the suffixes d further on.  Only those
    that are still equal to another move.  Bytes after the end count as the least.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    key = np.ascontiguousarray(head).view(">u8").ravel().astype(U)
    place = np.zeros(n + 1, np.int64)
    place[n] = -1  # what follows the last byte
    active, base, reached = np.arange(n), np.zeros(n, np.int64), 8
    while True:
        # active: suffixes to sort, `base` the place of the first that is equal so far; both in the order of base.
        order = np.argsort(key)
        active, base, key = active[order], base[order], key[order]
        m = np.arange(len(active))
        new_base = np.ones(len(active), bool)
        new_base[1:] = base[1:] != base[:-1]
        new = new_base.copy()
        new[1:] |= key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, m, 0))
        base = base + first - np.maximum.accumulate(np.where(new_base, m, 0))
        place[active] = base
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, base = active[~alone], base[~alone]
        if reached >= depth or not len(active):
            return place[:n]
        step = min(reached, depth - reached)
        key = (base << 32) + place[np.minimum(active + step, n)] + 1
        reached += step


def _suffixes(cut: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of phrases: the phrase, the start in it, and the place in the order of all, of each string of LENGTH bytes."""
    sizes = np.array([len(c) for c in cut], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = ranks(np.frombuffer(b"".join(cut), np.uint8), LENGTH)
    starts = np.arange(len(place))
    owner = np.repeat(np.arange(len(cut)), sizes)
    inside = starts + LENGTH <= bounds[owner + 1]
    return owner[inside], (starts - bounds[owner])[inside], place[inside]


def _runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of places that follow one another."""
    if not len(owner):
        return owner, place, place
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
    return owner[first], place[first], place[last]


MARK = ["doc", "tag", "from", "until"]
MARK_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _ordered(batches):
    """Marks of the repeated strings in phrases grouped by trigger: suffixes in order, equal neighbours marked."""
    for batch in batches:
        column = batch.column(0)
        for at in range(0, batch.num_rows, 256):
            groups = column.slice(at, 256).to_pylist()
            for a, b in slices([sum(len(p["bytes"]) for p in g) for g in groups], SLICE):
                rows = [p for g in groups[a:b] for p in g]
                owner, place, rank = _suffixes([p["bytes"] for p in rows])
                order = np.argsort(rank, kind="stable")
                same = rank[order][1:] == rank[order][:-1]
                equal = np.zeros(len(rank), bool)
                equal[order[1:][same]] = equal[order[:-1][same]] = True
                equal &= np.array([p["single"] for p in rows], bool)[owner]
                owner, first, last = _runs(owner[equal], place[equal])
                start = np.array([p["first"] for p in rows], np.int64)[owner]
                yield as_batch([np.array([p["doc"] for p in rows], np.int64)[owner], np.array([p["tag"] for p in rows], np.int64)[owner], (start + first).astype(np.int32), (start + last + LENGTH).astype(np.int32)], MARK_TYPES, MARK)


def _dealt(batches):
    """(trigger, string, doc, tag, start, single) of each string of (trigger, doc, tag, first, single, bytes)."""
    names = ["trigger", "string", "doc", "tag", "start", "single"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    for batch in batches:
        for trigger, doc, tag, first, single, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(0, len(phrase) - LENGTH + 1, 50_000):
                starts = range(at, min(at + 50_000, len(phrase) - LENGTH + 1))
                n = len(starts)
                yield as_batch([np.full(n, trigger), [digest(phrase[i : i + LENGTH]) for i in starts], np.full(n, doc), np.full(n, tag), np.arange(first + at, first + at + n, dtype=np.int32), np.full(n, single)], types, names)


def _kept(batches):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of (doc_id, text, marks)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        out = []
        for i, (doc_id, marks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            text, pieces, at, removed, spans = texts[i].as_py() or b"", [], 0, 0, 0
            for a, b in sorted((m["from"], m["until"]) for m in marks or ()):
                if a > at or not spans:
                    pieces.append(text[at:a])
                    spans, removed, at = spans + 1, removed + b - a, b
                elif b > at:
                    removed, at = removed + b - at, b
            pieces.append(text[at:])
            kept = b"".join(pieces)
            out.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            if len(out) == 256:
                yield as_batch([list(x) for x in zip(*out, strict=True)], types, names)
                out = []
        if out:
            yield as_batch([list(x) for x in zip(*out, strict=True)], types, names)


def marks(docs: DataFrame) -> DataFrame:
    """(doc, tag, from, until): byte ranges that go, overlapping or not, of documents (doc, tag, text)."""
    counted = docs.select("text").mapInArrow(_count, "trigger long, n long, again boolean")
    triggers = stored(counted.groupBy("trigger").agg(F.sum("n").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("trigger"), "triggers")
    parsed = docs.select("doc", "tag", "text").mapInArrow(_parse, "trigger long, content binary, doc long, tag long, first int, last int, again boolean")
    found = stored(parsed.join(triggers, "trigger", "left_semi"), "phrases")
    discard(triggers)
    dictionary = found.groupBy("trigger", "content").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("doc", "tag", "first", "last")).alias("at"))
    dictionary = stored(dictionary, "dictionary")
    whole = found.join(dictionary.where("n > 1").select("trigger", "content"), ["trigger", "content"], "left_semi").selectExpr("doc", "tag", "first as from", f"last + {LENGTH} as until")
    size = F.sum((F.col("at.last") - F.col("at.first") + LENGTH).cast("long"))
    open_ = dictionary.groupBy("trigger").agg(F.count("*").alias("k"), size.alias("bytes"), F.min("n").alias("least"), F.max("again").alias("again")).where("least = 1 and (k > 1 or again)")
    wanted = dictionary.join(open_.select("trigger", (F.col("bytes") > GROUP).alias("many")), "trigger").select("at.*", F.struct("trigger", "many", F.col("at.first").alias("first"), F.col("at.last").alias("last"), (F.col("n") == 1).alias("single")).alias("w"))
    wanted = wanted.groupBy("doc", "tag").agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(_cut, "trigger long, many boolean, doc long, tag long, first int, single boolean, bytes binary")
    cut = stored(cut, "cut")
    few = cut.where("not many").groupBy("trigger").agg(F.collect_list(F.struct("doc", "tag", "first", "single", "bytes")).alias("g"))
    by_group = few.select("g").mapInArrow(_ordered, "doc long, tag long, from int, until int")
    dealt = cut.where("many").select("trigger", "doc", "tag", "first", "single", "bytes").mapInArrow(_dealt, "trigger long, string binary, doc long, tag long, start int, single boolean")
    twice = dealt.groupBy("trigger", "string").agg(F.count("*").alias("n")).where("n > 1").select("trigger", "string")
    one_by_one = dealt.where("single").join(twice, ["trigger", "string"], "left_semi").selectExpr("doc", "tag", "start as from", f"start + {LENGTH} as until")
    return whole.unionByName(by_group).unionByName(one_by_one)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes (cuts may fall within a character).

    A null text counts as empty; a text under LENGTH bytes loses nothing; repeated rows are documents of their own, so each loses
    what it shares with the other.  Rows of one doc_id, or of none, and different texts are told apart by hashes of the text: 64 bits
    beside an id, 128 without.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text")).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    # A set, as equal rows bring equal marks.
    found = stored(marks(own.select("doc", "tag", "text")).groupBy("doc", "tag").agg(F.collect_set(F.struct("from", "until")).alias("marks")), "marks")
    joined = own.join(found, ["doc", "tag"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
