"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tripmart.llm.hashing import rows_of
from tripmart.llm.text import column, written

#: A span is several consecutive sentences with at least so many words together, or one sentence with so many by itself.
SPAN_WORDS, LONE_WORDS = 20, 20

#: Every character of a text belongs to one sentence: up to and with its end marks and the white space after them.
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n \t\r]*|[.!?\n \t\r]+")


def sentences(text: str | None) -> list[str]:
    return _SENTENCE.findall(text) if text else []


def spans(parts: list[str], span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> dict[tuple[int, int], int]:
    """(first, last) sentence -> hash of every shortest span of enough words that starts or ends at a sentence.

    Sentences without words belong to no span's start or end. White space at the ends of sentences does not count.
    """
    full = [i for i, p in enumerate(parts) if p.strip()]
    words = [len(parts[i].split()) for i in full]
    found: set[tuple[int, int]] = set()
    lone = {i for i, n in enumerate(words) if n >= lone_words}
    found.update((i, i) for i in lone)
    # two pointers: for a start the shortest span, and then for an end
    end = total = 0
    for start in range(len(full)):
        while end < len(full) and (total < span_words or end - start < 2):
            total += words[end]
            end += 1
        if total >= span_words and end - start >= 2:
            found.add((start, end - 1))
        total -= words[start]
    start, total = len(full) - 1, 0
    for end in range(len(full) - 1, -1, -1):
        while start >= 0 and (total < span_words or end - start < 2):
            total += words[start]
            start -= 1
        if total >= span_words and end - start >= 2:
            found.add((start + 1, end))
        total -= words[end]
    bare = [parts[i].strip() for i in full]
    return {(full[a], full[b]): _signed(xxh3_64_intdigest(" ".join(bare[a:b + 1]).encode("utf-8", "surrogatepass")))
            for a, b in found}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hashes(span_words: int, lone_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            ids, out = [], []
            for i, text in zip(rows.column("doc").to_pylist(), rows.column("text")):
                own = np.unique(np.fromiter(spans(sentences(text.as_py()), span_words, lone_words).values(), np.int64))
                out.append(own)
                ids.append(np.full(len(own), i, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids))], names=["span", "doc"])
    return run


def cut(text: str, later: set[int], span_words: int, lone_words: int) -> tuple[list[str], list[bool]]:
    """The sentences, and which of them go: covered by a span of `later`, or by a repeat of a span in the text itself."""
    parts = sentences(text)
    gone, seen = [False] * len(parts), set()
    for (a, b), h in sorted(spans(parts, span_words, lone_words).items()):
        if h in later or h in seen:
            gone[a:b + 1] = [True] * (b + 1 - a)
        seen.add(h)
    return parts, gone


def _rewrite(span_words: int, lone_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            kept, n, removed = [], [], []
            for text, later in zip(rows.column("text").to_pylist(), rows.column("later").to_pylist()):
                parts, gone = cut(text, set(later or ()), span_words, lone_words)
                kept.append(None if text is None else "".join(p for p, g in zip(parts, gone) if not g))
                n.append(len(parts))
                removed.append(sum(gone))
            names = [c for c in rows.schema.names if c not in ("text", "later")]
            yield pa.record_batch([*[rows.column(c) for c in names], pa.array(kept, pa.string()),
                                   pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                                  names=[*names, "text", "n_sentences", "n_removed"])
    return run


def later_spans(docs: DataFrame, span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """`doc`, `later`: the spans of a document that a document with a smaller id holds too.

    One row per span and document is stored: 16 bytes for about a sentence. Counting by span is combined before the
    shuffle, so a passage in very many documents is one row per task; joined back, the rows of a very frequent span
    are many but small, and adaptive execution splits them.
    """
    doc = F.coalesce(column(docs, "doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    held = written(docs.select(doc, column(docs, "text").alias("text")).mapInArrow(
        _hashes(span_words, lone_words), "span long, doc long"), "sentence-spans")
    first = held.groupBy("span").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(
        "first < last").select("span", "first")
    return held.join(first, "span").where("doc > first").groupBy("doc").agg(F.collect_set("span").alias("later"))


def dedup(docs: DataFrame, span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """`doc_id`, `text` (what is kept), `n_sentences`, `n_removed` of every document.

    Every run of several consecutive sentences with `span_words` words together, and every sentence with `lone_words`,
    is hashed and joined globally. Runs with fewer words, and what is shared within sentences only, stay. The
    first occurrence (smallest doc_id, then place) stays; sentences that any other occurrence covers go. Null text stays
    null. Null doc_ids come last; rows with one id, null included, are versions of one document and are not compared
    with each other. Texts of one sentence lose it only if it has `lone_words` words. No rows give no rows.
    """
    later = later_spans(docs, span_words, lone_words).withColumnRenamed("doc", "_doc")
    here = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))
    joined = here.join(later, F.expr(f"coalesce(doc_id, {(1 << 63) - 1}) = _doc"), "left").select("doc_id", "text", "later")
    return joined.mapInArrow(_rewrite(span_words, lone_words),
                             "doc_id long, text string, n_sentences long, n_removed long")


def rewrite(docs: DataFrame, span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """The documents with their kept text, columns as they are; documents of which nothing but white space is left go.

    A document that had no words before stays. `n_chars`, where it is there, follows the text. Cases as in `dedup`.
    """
    marks = later_spans(docs, span_words, lone_words)
    # by number: names may hold dots
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    plain = docs.toDF(*names)
    doc_id = F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit((1 << 63) - 1))
    joined = plain.join(marks, doc_id == F.col("doc"), "left").drop("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            texts, stays = [], []
            for text, gone_spans in zip(rows.column(at).to_pylist(), rows.column("later").to_pylist()):
                parts, gone = cut(text, set(gone_spans or ()), span_words, lone_words)
                kept = None if text is None else "".join(p for p, g in zip(parts, gone) if not g)
                texts.append(kept)
                stays.append(not any(gone) or bool(kept.strip()))
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(rows.columns[:len(names)])]
            yield pa.record_batch(columns, names=names).filter(pa.array(stays, pa.bool_()))

    out = joined.mapInArrow(run, plain.schema)
    if "n_chars" in docs.columns:
        n_chars = names[docs.columns.index("n_chars")]
        out = out.withColumn(n_chars, F.when(F.col(n_chars).isNotNull(), F.length(names[at]).cast(plain.schema[n_chars].dataType)))
    return out.toDF(*docs.columns)
