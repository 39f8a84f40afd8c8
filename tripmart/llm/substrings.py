"""Repeated byte strings across and within texts, found by suffix arrays over the places that share an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tripmart.llm.hashing import mix64, odd_numbers, rows_of
from tripmart.llm.suffixes import suffix_array
from tripmart.llm.text import column, written

#: A string of so many bytes that starts in two places is a repeat.
LENGTH = 200
#: Bytes of an anchor gram. Each string of LENGTH bytes belongs to the smallest gram in it.
ANCHOR = 32
#: Bytes of the grams of which the smallest in each window cut a context into blocks.
EDGE = 8
#: Repeated anchors up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ANCHORS = 4_000_000
#: Different contexts of one anchor that a task looks at together; strings of more are compared by a shuffle.
MOST_CONTEXTS = 10_000

_SEGMENT = 1 << 20
_SLICE = 2 << 20
_MASK = np.uint64((1 << 24) - 1)
_BYTES = odd_numbers(256, 21)
_STEP = int(odd_numbers(1, 23)[0])
_BACK = pow(_STEP, -1, 1 << 64)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k bytes (k a power of two), by doubling."""
    h, reach = _BYTES[data], 1
    while reach < k:
        if len(h) <= reach:
            return h[:0]
        h = h[:-reach] * np.uint64(0x9FB21C651E98DF25) + h[reach:]
        h ^= h >> np.uint64(32)
        reach *= 2
    return mix64(h)


def smallest(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window of neighbouring hashes the place of the smallest one (leftmost if several)."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    low = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < window:
        low = np.minimum(low[:reach - window], low[window - reach:])
    return (low & _MASK).astype(np.int64)


class Strings:
    """Hashes of any strings of a byte array, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        ahead = np.full(len(data) + 1, _STEP, np.uint64)
        ahead[0] = 1
        back = np.full(len(data) + 1, _BACK, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * np.cumprod(ahead)[:-1])])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def segments(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): every string of `length` bytes lies in exactly one segment from its start on."""
    for start in range(0, max(len(data) - length + 1, 0), _SEGMENT):
        yield start, data[start:start + _SEGMENT + length - 1]


def contexts(data: bytes, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(anchor hash, offset, bytes before the anchor, bytes): all strings of a text, put together by their anchor."""
    for offset, part in segments(data, length):
        grams = gram_hashes(np.frombuffer(part, np.uint8), ANCHOR)
        owner = smallest(grams, length - ANCHOR + 1)
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        lasts = np.append(firsts[1:], len(owner)) - 1
        hashes = grams[owner[firsts]].view(np.int64).tolist()
        for h, a, b, at in zip(hashes, firsts.tolist(), lasts.tolist(), owner[firsts].tolist()):
            yield h, offset + a, at - a, part[a:b + length]


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _kind(left: int, part: bytes) -> int:
    """A context's digest: with the anchor's hash, 128 bits that stand for its bytes and the place of its anchor."""
    return xxh3_64_intdigest(part, left) - (1 << 63)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 1 << 20):
            anchors, kinds, keys = [], [], []
            for key, text in zip(rows.column("key").to_pylist(), rows.column("text")):
                for h, _, left, part in contexts(_data(text.as_py()), length):
                    anchors.append(h)
                    kinds.append(_kind(left, part))
                    keys.append(key)
            if anchors:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (anchors, kinds, keys)], names=["anchor", "kind", "key"])
    return run


_CONTEXT = "anchor long, kind long, key long, doc_id long, start long, left int, data binary"
_CONTEXT_NAMES = ["anchor", "kind", "key", "doc_id", "start", "left", "data"]
_CONTEXT_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.binary()]


def _contexts(length: int, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 1 << 19):
            only = rows.column("anchors").to_pylist() if wanted else [None] * rows.num_rows
            out = []
            for key, doc_id, text, some in zip(*[rows.column(c).to_pylist() for c in ("key", "doc_id", "text")], only):
                some = None if some is None else set(some)
                out += [(h, _kind(left, part), key, doc_id, at, left, part)
                        for h, at, left, part in contexts(_data(text), length) if some is None or h in some]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), _CONTEXT_TYPES)], names=_CONTEXT_NAMES)
    return run


def repeated_starts(group: list[int], left: list[int], parts: list[bytes], length: int) -> list[np.ndarray]:
    """For distinct contexts (group number, bytes before the anchor, bytes): which starts in each have a repeat.

    The contexts are cut into blocks at content-defined places, so that any string of `length` bytes in two contexts has
    whole blocks in common. One suffix array over all blocks, with an own separator behind each context, shows for every
    block how many blocks from it on some other place repeats. Only strings within such a run and the bytes beside it
    can be repeats; these are compared: equal strings of one anchor have equal places relative to it, equal hashes, and
    equal bytes.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(parts)), sizes)
    strings = Strings(data)

    # A cut inside a shared string depends on nothing outside of it unless it is within a window of its ends. A quarter
    # of the string's grams as a window leaves two windows, so two cuts with whole blocks between them, in the middle.
    window = (length - EDGE + 3) // 4
    low = smallest(gram_hashes(data, EDGE), window)
    whole = of[:len(low)] == of[window + EDGE - 2:][:len(low)]
    cuts = np.unique(low[whole])
    same = of[cuts[:-1]] == of[cuts[1:]]
    head, tail = cuts[:-1][same], cuts[1:][same]
    _, symbols = np.unique(strings.hashes(head, tail), return_inverse=True)
    owner = of[head]
    # blocks of a context in order, then its separator; separators are smaller than blocks
    place = np.arange(len(head)) + owner
    text = np.full(len(head) + len(parts), -1, np.int64)
    text[place] = symbols + len(parts)
    text[text < 0] = np.arange(len(parts))
    order = np.array(suffix_array(text.tolist()), np.int64)
    run = np.zeros(len(text) + 1, np.int64)
    a, b, shared = order[:-1], order[1:], np.zeros(len(order) - 1, np.int64)
    alive = np.arange(len(a))
    while len(alive):
        x, y = a[alive] + shared[alive], b[alive] + shared[alive]
        ok = (x < len(text)) & (y < len(text))
        ok[ok] = text[x[ok]] == text[y[ok]]
        alive = alive[ok]
        shared[alive] += 1
    np.maximum.at(run, a, shared)
    np.maximum.at(run, b, shared)

    hit = np.flatnonzero(run[place] > 0)
    last = hit + run[place][hit] - 1
    # the first cut that two equal strings share is less than two windows from where they begin, the last from the end
    before = np.maximum(head[hit] - 2 * window, begins[owner[hit]])
    after = np.minimum(tail[last] + 2 * window + EDGE, (begins + sizes)[owner[hit]])
    marks = np.zeros(len(data) + 1, np.int64)
    wide = after - before >= length
    np.add.at(marks, before[wide], 1)
    np.add.at(marks, after[wide] - length + 1, -1)
    own_start = np.arange(len(data)) - begins[of]
    maybe = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (own_start + length <= sizes[of]))

    beside = np.array(group, np.int64)[of[maybe]] * 4096 + np.array(left)[of[maybe]] - own_start[maybe]
    again = maybe[_met_again(data, maybe, mix64(strings.hashes(maybe, maybe + length) ^ beside.astype(np.uint64)), beside, length)]
    return np.split(again - begins[of[again]], np.searchsorted(of[again], np.arange(1, len(parts))))


def _met_again(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray, beside: np.ndarray, length: int) -> np.ndarray:
    """Which strings (start, a number beside it) have an equal one. Hashes bring them together, bytes decide."""
    out = np.zeros(len(starts), bool)
    order = np.argsort(hashes, kind="stable")
    pairs = np.flatnonzero(hashes[order[:-1]] == hashes[order[1:]])
    for some in np.array_split(pairs, len(pairs) // 4096 + 1):
        a, b = order[some], order[some + 1]
        reach = np.arange(length)
        if not ((data[starts[a, None] + reach] == data[starts[b, None] + reach]).all() and (beside[a] == beside[b]).all()):
            break
        out[a] = out[b] = True
    else:
        return out
    # two different strings share a hash: all are told apart by their bytes
    seen: dict[tuple, list[int]] = {}
    for i, (start, more) in enumerate(zip(starts.tolist(), beside.tolist())):
        seen.setdefault((more, data[start:start + length].tobytes()), []).append(i)
    out[:] = False
    out[[i for at in seen.values() if len(at) > 1 for i in at]] = True
    return out


def _runs(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Starts of repeats as byte ranges."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return [{"lo": lo, "hi": hi + length} for lo, hi in zip(
        starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist())]


_FOUND = "anchor long, kind long, ranges array<struct<lo: long, hi: long>>"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("kind", pa.int64()),
                          ("ranges", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])


def resolve(rows: list[tuple], length: int) -> list[tuple[int, int, list]]:
    """(anchor, kind, ranges) of the repeats in different contexts (anchor, kind, left, data, n) of whole anchor groups.

    A context that is there several times is a repeat from end to end; the others are compared within their groups.
    """
    numbers: dict[int, int] = {}
    group = [numbers.setdefault(r[0], len(numbers)) for r in rows]
    found = repeated_starts(group, [r[2] for r in rows], [r[3] for r in rows], length)
    out = [(r[0], r[1], [{"lo": 0, "hi": len(r[3])}] if r[4] > 1 else _runs(starts, length)) for r, starts in zip(rows, found)]
    return [r for r in out if r[2]]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)


def _resolve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in rows_of(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > _SLICE and row[0] != held[-1][0]:
                    if found := resolve(held, length):
                        yield _found(found)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held and (found := resolve(held, length)):
            yield _found(found)
    return run


def _every_string(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 1 << 16):
            out = [(xxh3_128_digest(data[i:i + length]), anchor, kind, i, n)
                   for anchor, kind, _, data, n in zip(*[c.to_pylist() for c in rows.columns])
                   for i in range(len(data) - length + 1)]
            if out:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                      names=["string", "anchor", "kind", "lo", "n"])
    return run


def _string_by_string(contexts_: DataFrame, length: int) -> DataFrame:
    """What `resolve` finds, for anchors with very many different contexts: their strings meet in a shuffle."""
    every = written(contexts_.mapInArrow(_every_string(length), "string binary, anchor long, kind long, lo long, n long"),
                    "substrings-strings")
    again = every.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    spans = F.struct("lo", (F.col("lo") + length).alias("hi"))
    return every.join(again, "string", "left_semi").groupBy("anchor", "kind").agg(F.collect_list(spans).alias("ranges"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS,
                    broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """`key`, `doc_id`, `lo`, `hi`: byte ranges of `docs` (`key`, `doc_id`, `text`) that are covered by repeats.

    Each string of `length` bytes belongs to the smallest 32-gram in it, so equal strings have equal anchors, at equal
    places. An anchor's strings travel as one context of at most 2 * `length` bytes. Only anchors that are there twice
    matter. Where all contexts of an anchor are equal, each is a repeat from end to end, and no bytes are sent. Of the
    others each different context is sent once, with its number, so copies make no anchor large; a task reads whole
    anchor groups as a sorted stream, about 2 MB at a time. What it finds goes back to all places of a context. Anchors
    of more than `most_contexts` different contexts are not gathered: their strings meet one by one in a shuffle.
    """
    anchors = docs.select("key", "text").mapInArrow(_anchors(length), "anchor long, kind long, key long")
    repeated = written(anchors.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("kind").alias("least"), F.max("kind").alias("most")).where("n > 1").select(
        "anchor", (F.col("least") == F.col("most")).alias("same")), "substrings-anchors")
    if repeated.count() <= broadcast_anchors:
        pieces = docs.select("key", "doc_id", "text").mapInArrow(_contexts(length, False), _CONTEXT).join(
            F.broadcast(repeated), "anchor")
    else:
        wanted = anchors.join(repeated, "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
        pieces = docs.join(wanted, "key").select("key", "doc_id", "text", "anchors").mapInArrow(
            _contexts(length, True), _CONTEXT).join(repeated, "anchor")
    pieces = written(pieces.select("anchor", "kind", "same", "key", "doc_id", "start", "left", F.length("data").alias("size"),
                                   F.when(~F.col("same"), F.col("data")).alias("data")), "substrings-contexts")
    mixed = pieces.where("NOT same")
    different = written(mixed.groupBy("anchor", "kind", "left", "data").agg(F.count("*").alias("n")), "substrings-different")
    many = different.groupBy("anchor").count().where(F.col("count") > most_contexts).select("anchor")
    crowded = not many.isEmpty()
    few = different.join(many, "anchor", "left_anti") if crowded else different
    found = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve(length), _FOUND)
    if crowded:
        found = found.unionByName(_string_by_string(different.join(many, "anchor", "left_semi"), length))
    spans = mixed.select("anchor", "kind", "key", "doc_id", "start").join(found, ["anchor", "kind"]).select(
        "key", "doc_id", "start", F.inline("ranges"))
    return pieces.where("same").select("key", "doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")
        ).unionByName(spans.select("key", "doc_id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *[hi for _, hi in gone]]
    return b"".join(data[a:b] for a, b in zip(ends, [*[lo for lo, _ in gone], len(data)]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        out = []
        for doc_id, text, ranges in zip(*[rows.column(c).to_pylist() for c in ("doc_id", "text", "ranges")]):
            data, gone = _data(text), merged([(r["lo"], r["hi"]) for r in ranges or ()])
            out.append((doc_id, len(data), sum(hi - lo for lo, hi in gone), len(gone), _kept(data, gone)))
        ids, sizes, removed, spans, kept = zip(*out)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(removed), pa.array(spans),
                               pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept` (bytes) of every document.

    Every byte goes that is covered by a string of `length` bytes that also starts elsewhere, in the same text or
    another. Null text is empty; texts shorter than `length` lose nothing. Equal rows are separate documents, so both
    lose what they share. Ids may be null or repeat. No rows give no rows.
    """
    keyed = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    # a key may be shared by chance: together with the id it only joins a few ranges more, of other texts
    ranges = repeated_ranges(keyed, length, **options).groupBy(
        F.col("key").alias("_key"), F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = keyed.join(ranges, F.expr("key = _key AND doc_id <=> _id"), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
