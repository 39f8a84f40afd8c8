"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_hexdigest

from tripmart.llm.hashing import odd_numbers
from tripmart.llm.text import column, written

#: Bytes of a chunk: none shorter (but the last), about so long, none longer.
SHORTEST, NORMAL, LONGEST = 32, 128, 512
#: Bits of the gear hash that must be zero before and after the normal length.
HARD_BITS, EASY_BITS = 9, 5

_GEAR = (odd_numbers(256, 9) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: h = 2 h + gear[byte] in 32 bits, so it depends on the last 32 bytes only.

    Sums over 2, 4, ... 32 bytes are built by doubling. No hash starts anew at a chunk, which keeps the boundaries of
    a passage the same wherever it stands.
    """
    h = _GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        shifted = h[:-reach] << np.uint32(reach)
        h = h.copy()
        h[reach:] += shifted
    return h


def boundaries(data: bytes, shortest: int = SHORTEST, normal: int = NORMAL, longest: int = LONGEST,
               hard_bits: int = HARD_BITS, easy_bits: int = EASY_BITS) -> list[int]:
    """Ends of the chunks. A boundary needs many zero bits up to the normal length and fewer beyond (normalised)."""
    h = gear_hashes(np.frombuffer(data, np.uint8)) if data else np.empty(0, np.uint32)
    easy = np.flatnonzero(h >> np.uint32(32 - easy_bits) == 0) + 1
    hard = np.flatnonzero(h >> np.uint32(32 - hard_bits) == 0) + 1
    easy, hard = easy.tolist(), hard.tolist()
    ends, start, e, d = [], 0, 0, 0
    while start < len(data):
        end = min(start + longest, len(data))
        while d < len(hard) and hard[d] < start + shortest:
            d += 1
        if d < len(hard) and hard[d] <= min(start + normal, end):
            end = hard[d]
        else:
            while e < len(easy) and easy[e] <= start + normal:
                e += 1
            if e < len(easy) and easy[e] < end:
                end = easy[e]
        ends.append(end)
        start = end
    return ends


def fingerprint(text: str) -> dict[str, int]:
    """Digest of every distinct chunk of a text -> its length in bytes."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in boundaries(data):
        out[xxh3_64_hexdigest(data[start:end])] = end - start
        start = end
    return out


def as_string(chunks: dict[str, int]) -> str:
    """Sorted `digest:length`, so equal sets are equal strings."""
    return " ".join(f"{d}:{n:x}" for d, n in sorted(chunks.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of the smaller set, in bytes of chunks, that the other one holds; two empty sets are alike."""
    if not a and not b:
        return 1.0
    small = min(sum(a.values()), sum(b.values()))
    return sum(n for d, n in a.items() if d in b) / small if small else 0.0


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of the one that follows."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third] if third else text


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, part int, edge string, text string")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _sha(text: str) -> str:
    import hashlib
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Doc:
    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.chunks = fingerprint(self.text)

    def row(self, following: "_Doc") -> dict:
        changed = edited(self.text, following.text)
        own = self.chunks if changed == self.text else fingerprint(changed)
        return {"doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": _sha(changed),
                "fingerprint": as_string(self.chunks), "edited_fingerprint": as_string(own),
                "near_edited": containment(self.chunks, own), "near_next": containment(self.chunks, following.chunks)}


def _in_slices(rows: Iterator[dict], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 400 + 2 * len(row.get("fingerprint") or "") + 4 * len(row.get("text") or "")
        if size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order, each with its next one; the first and last texts also as `edge` rows."""
    def rows() -> Iterator[dict]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc = _Doc(doc_id.as_py(), text.as_py())
                if before is None:
                    yield {"doc_id": doc.doc_id, "part": part, "edge": "first", "text": doc.text}
                else:
                    yield before.row(doc)
                before = doc
        if before is not None:
            yield {"doc_id": before.doc_id, "part": part, "edge": "last", "text": before.text}
    return _in_slices(rows())


def _over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for doc_id, text, following in zip(*[batch.column(c) for c in ("doc_id", "text", "following")]):
                yield _Doc(doc_id.as_py(), text.as_py()).row(_Doc(None, following.as_py()))
    return _in_slices(rows())


def compare_with_next(docs: DataFrame, partitions: Callable[[int], int] | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller id; after the last comes the first. One range shuffle puts
    neighbours beside each other, in order, and each partition is read as a stream. What is missing is the step from
    a partition's last row to the next partition's first: these rows (two a partition) are joined by partition number.

    Null text is empty. Null ids come last; rows with equal ids follow each other by a digest of the text. The range
    shuffle samples ids and digests only, so no text reaches the driver. A single document follows
    itself. No rows give no rows.
    """
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"),
                       F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = rows.withColumn("tie", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    done = written(ranged.drop("tie").mapInArrow(_along, _SCHEMA), "chunks-neighbours")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    # one row per partition that is not empty
    firsts = sorted(r["part"] for r in done.where("edge = 'first'").select("part").collect())
    if not firsts:
        return done.select(*names)
    after = docs.sparkSession.createDataFrame(list(zip(firsts, [*firsts[1:], firsts[0]])), "_at int, _after int")
    first = done.where("edge = 'first'").select(F.col("part").alias("_first"), F.col("text").alias("following"))
    edges = done.where("edge = 'last'").select("doc_id", "text", "part").join(
        after, F.col("part") == F.col("_at")).join(first, F.col("_after") == F.col("_first")).select(
        "doc_id", "text", "following")
    return done.where("edge IS NULL").select(*names).unionByName(
        edges.mapInArrow(_over_edges, _SCHEMA).select(*names))
