"""Language-model scores: a small causal self-attention model on subword ids, and the unigram score it is held against."""

from __future__ import annotations

import base64
import copy
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tripmart.llm.hashing import rows_of, spaced_words
from tripmart.llm.text import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Classes the attention model predicts: frequent ids by themselves, the others by the company they keep, the end.
SINGLE, SHARED = 40, 23
CLASSES = SINGLE + SHARED + 1
END = CLASSES - 1
#: Positions of a window, and how many of them only give context to the others (but in the first window of a text).
WINDOW, OVERLAP = 24, 8
WIDTH = 16
#: Windows of a step, and the fewest steps a whole input is worth: a smaller one is gone through several times.
STEPS, BATCH = 300, 256
#: Classes of a shard, on average. Texts go to shards by content.
SHARD = 1 << 21
#: The same where ids have weights of their own, which each shard hands on; learned in blocks of SHARD classes.
ID_SHARD = 1 << 24
#: Rate of the ids' weights, and the gradient of a batch's position that halves a first move.
ID_RATE, ID_CALM = 0.1, 1.0
#: Ids whose weights meet in one row when those of the shards are averaged.
ID_PART = 1 << 9
#: Sums over tasks are of whole numbers, exact in any order: weights count in so small parts, and log10 ratios of the two
#: experts in so many classes from -RATIO to RATIO.
PARTS, RATIO, RATIOS = float(1 << 24), 20.0, 4000
#: Words whose counts every task holds (16 bytes each); counts of the others are joined by a shuffle.
FREQUENT = 500_000
#: Bytes of text that share a dictionary in the table of tokens.
SLICE = 1 << 20
#: Added to the class of a subword that opens a word, where classes travel as bytes.
OPENS = 64

_encoders: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    return Path(path).read_bytes()


class Subwords:
    """Byte-pair ids of words, each with the space before it; words are cut after 32 characters for that."""

    def __init__(self, vocabulary: bytes):
        key = hash(vocabulary)
        if key not in _encoders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
            encoder = tiktoken.Encoding("words", pat_str=r" [^ ]{0,31}|[^ ]{1,32}", mergeable_ranks=ranks, special_tokens={})
            opens = np.zeros(encoder.n_vocab, bool)
            opens[[i for word, i in ranks.items() if word[:1] == b" "]] = True
            _encoders[key] = encoder, opens
        self.encoder, self.opens = _encoders[key]
        self.size = self.encoder.n_vocab

    def ids(self, word: bytes) -> list[int]:
        return self.encoder.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def all_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in a row. Words hold no space, so all are encoded in one call."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        ids = np.array(self.encoder.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int32)
        return np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))).astype(np.int32), ids


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_TOKENS = ("learn boolean, doc_ids array<long>, lengths binary, numbers binary, dictionary array<binary>, counts array<long>, "
           "sizes binary, ids binary")


def tokenise(docs: DataFrame, vocabulary: bytes, learn: Column | None = None) -> DataFrame:
    """Every whole text as numbers, read and cut into words once; a written table.

    A row holds about SLICE bytes of texts: `doc_ids`, `lengths` (words of each text), `numbers` (all words as places in
    `dictionary`), `counts` of the dictionary's words in the slice, `sizes` and `ids` (their subwords). Texts that
    `learn` holds for and others are in rows of their own.
    """
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Subwords(vocabulary)
        for rows in rows_of(batches, SLICE):
            for flag in (True, False):
                part = rows.filter(rows.column("learn") if flag else pc.invert(rows.column("learn")))
                if not part.num_rows:
                    continue
                known = _Numbers()
                texts = [spaced_words(t.as_py()) for t in part.column("text")]
                numbers = [np.fromiter(map(known.__getitem__, t), np.int32, len(t)) for t in texts]
                lengths, numbers, words = np.array([len(t) for t in texts], np.int32), np.concatenate(numbers), list(known)
                sizes, ids = coder.all_ids(words)
                counts = np.bincount(numbers, minlength=len(words)).astype(np.int64)
                yield pa.record_batch([
                    pa.array([flag]), _listed(part.column("doc_id")), pa.array([lengths.tobytes()]), pa.array([numbers.tobytes()]),
                    _listed(pa.array(words, pa.binary())), _listed(pa.array(counts)), pa.array([sizes.tobytes()]),
                    pa.array([ids.tobytes()])],
                    names=["learn", "doc_ids", "lengths", "numbers", "dictionary", "counts", "sizes", "ids"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn"))
    return written(read.mapInArrow(run, _TOKENS), "lm-tokens")


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tokens(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    return docs if "dictionary" in docs.columns else tokenise(docs, vocabulary)


def _numbers(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """These binary columns of every row as whole numbers."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(x)[i].as_py(), np.int32).astype(np.int64) for x in names]


def count_words(tokens: DataFrame) -> DataFrame:
    """`word` (bytes), `n`: occurrences in all texts; each slice of texts has counted its own."""
    return tokens.select(F.explode(F.arrays_zip("dictionary", "counts")).alias("w")).groupBy(F.col("w.dictionary").alias("word")).agg(
        F.sum("w.counts").alias("n"))


def count_subwords(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every subword id in all texts (the driver gets one number per id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for lengths, numbers, sizes, ids in _numbers(batches, "lengths", "numbers", "sizes", "ids"):
            counts = np.bincount(numbers, minlength=len(sizes))
            total += np.bincount(ids, np.repeat(counts, sizes), size).astype(np.int64)
        yield _keyed(total)

    found = _summed(tokens.select("lengths", "numbers", "sizes", "ids"), run, "lm-subwords")
    return np.pad(found, (0, size - len(found)))


def count_company(tokens: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often each id has each of the SINGLE most frequent ids as the last of these before it in its text, or none.

    The driver gets at most SINGLE + 1 numbers per id of the vocabulary.
    """
    single = np.full(len(counts) + 1, SINGLE)
    single[np.argsort(-counts, kind="stable")[:SINGLE]] = np.arange(SINGLE)
    end, wide = len(counts), SINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(counts) * wide, np.int64)
        for lengths, numbers, sizes, ids in _numbers(batches, "lengths", "numbers", "sizes", "ids"):
            flat, starts, ends, place = _layout(lengths, numbers, sizes, ids, end)
            kind = single[flat]
            last = np.maximum.accumulate(np.where((kind < SINGLE) | ~place, np.arange(len(flat)), 0))
            before = np.concatenate([[SINGLE], kind[last[:-1]]])
            np.add.at(total, (flat * wide + before)[place], 1)
        yield _keyed(total)

    found = _summed(tokens.select("lengths", "numbers", "sizes", "ids"), run, "lm-company")
    return np.pad(found, (0, len(counts) * wide - len(found))).reshape(len(counts), wide)


def _clusters(profiles: np.ndarray, weights: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of weighted unit vectors, begun at vectors drawn far apart; the same for the same input."""
    rng = np.random.default_rng(3)
    near, centres = np.zeros(len(profiles)), []
    for _ in range(min(n, len(profiles))):
        chance = np.cumsum(weights * np.maximum(1 - near, 1e-9))
        centres.append(profiles[min(np.searchsorted(chance, rng.random() * chance[-1]), len(profiles) - 1)])
        near = np.maximum(near, profiles @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        of = (profiles @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            mean = weights[of == k] @ profiles[of == k]
            if mean.any():
                centres[k] = mean / np.linalg.norm(mean)
    return (profiles @ centres.T).argmax(axis=1)


def classes_of(counts: np.ndarray, company: np.ndarray, coder: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """The class of every id, and its log10 probability within the class.

    Frequent ids have classes of their own, the others share them by clusters of their company, so that the classes met
    so far tell what kind of text this is. Ids that open a word and those that go on share no class.
    """
    order = np.argsort(-counts, kind="stable")
    of = np.zeros(len(counts), np.int64)
    of[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    prior = (company.sum(axis=0) + 1.0) / (company.sum() + company.shape[1])
    profiles = np.sqrt((company + 5 * prior) / (company.sum(axis=1, keepdims=True) + 5))
    half = SHARED // 2
    for ids, first, n in ((rest[coder.opens[rest]], SINGLE, half), (rest[~coder.opens[rest]], SINGLE + half, SHARED - half)):
        if len(ids):
            of[ids] = first + _clusters(profiles[ids], counts[ids] + 0.5, n)
    inside = counts + 0.5
    return of, np.log10(inside / np.bincount(of, inside, CLASSES)[of])


class Ids:
    """Weights of every subword id beside those of its class, and the way from a class to each of its ids.

    The query, key and value of an id are its class's plus `own[id]`; the last row is the end's. Within its class an id is
    reached by turns in a Huffman tree of the class's ids by count: at a node the turn is right with odds
    exp(turn[node] . (weighted values, 1)). So probabilities of the ids of a class sum to 1 after any context, and without
    learning they are the shares of the counts.
    """

    NAMES = ("own", "turn")

    def __init__(self, of: np.ndarray, counts: np.ndarray):
        self.of, self.end = np.append(of, END), len(of)
        #: Places in an order by class, in which a class's ids stand together.
        self.by_rank = np.argsort(self.of, kind="stable")
        self.rank = np.empty(len(self.of), np.uint16 if len(self.of) <= 1 << 16 else np.int64)
        self.rank[self.by_rank] = np.arange(len(self.of))
        leaves, nodes, sides, lean, total = [], [], [], [], 0
        for ids in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=CLASSES))[:-1]):
            n = len(ids)
            if n < 2:
                continue
            up, side, odds = _tree((counts[ids] + 0.5).tolist())
            at = np.arange(n)
            while len(at):
                low = at < 2 * n - 2
                at, ids = at[low], ids[low]
                leaves.append(ids)
                nodes.append((total + up[at] - n).astype(np.int32))
                sides.append(side[at])
                at = up[at]
            lean.append(odds)
            total += n - 1
        leaves = np.concatenate([*leaves, np.empty(0, np.int64)])
        order = np.argsort(leaves, kind="stable")
        self.depth = np.bincount(leaves, minlength=len(self.of))
        self.first = np.cumsum(self.depth) - self.depth
        self.depth = self.depth.astype(np.int16)
        self.path = np.concatenate([*nodes, np.empty(0, np.int32)])[order].astype(np.uint16 if total <= 1 << 16 else np.int32)
        self.side = np.concatenate([*sides, np.empty(0, np.float32)])[order]
        self.own = np.zeros((len(self.of), 3 * WIDTH), np.float32)
        self.turn = np.zeros((total, WIDTH + 1), np.float32)
        self.turn[:, WIDTH] = np.concatenate([*lean, np.empty(0)])

    def with_weights(self, own: np.ndarray, turn: np.ndarray) -> "Ids":
        out = copy.copy(self)
        out.own, out.turn = own, turn
        return out

    def turns(self, h: np.ndarray, ahead: np.ndarray, weight: np.ndarray | None = None):
        """log probability of every id within its class after these weighted values; with weights of the positions also
        which positions make turns, the gradients of their values, and the gradients of turns as of Attention."""
        n = np.take(self.depth, ahead)
        some = np.argsort(n, kind="stable")[::-1][:np.count_nonzero(n)]
        # first turns of all positions, then second ones ..., the longest ways first: each level is a run of rows
        level = np.cumsum(np.bincount(n[some])[::-1])[::-1][1:] if len(some) else np.empty(0, np.int64)
        runs = list(zip(np.cumsum(level) - level, level))
        at = _counted(level)
        step = np.take(np.take(self.first, ahead[some]), at) + np.repeat(np.arange(len(level)), level)
        node, side = np.take(self.path, step), np.take(self.side, step)
        turn, values = np.take(self.turn, node, axis=0), np.ones((len(some), WIDTH + 1), h.dtype)
        values[:, :WIDTH] = np.take(h, some, axis=0)
        values = np.take(values, at, axis=0)
        odds = np.exp(np.minimum(np.einsum("ij,ij->i", values, turn) * -side, 60))
        lost, found = np.log(1 + odds), np.zeros(len(some), h.dtype)
        for a, k in runs:
            found[:k] -= lost[a:a + k]
        inside = np.zeros(len(ahead), h.dtype)
        inside[some] = found
        if weight is None:
            return inside
        odds /= -(1 + odds)
        odds *= side
        odds *= np.take(np.take(weight, some), at)
        turn *= odds[:, None]
        values *= odds[:, None]
        back = np.zeros((len(some), WIDTH), h.dtype)
        for a, k in runs:
            back[:k] += turn[a:a + k, :WIDTH]
        return inside, some, back, _sums(node, values)


def _tree(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree: the node above every leaf and node (leaves first, the top last), on which side (1: right, -1: left),
    and for every inner node the log odds of the right side."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, side, odds = np.zeros(2 * n - 1, np.int64), np.ones(2 * n - 1, np.float32), np.empty(n - 1)
    for node in range(n, 2 * n - 1):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        up[left] = up[right] = node
        side[left] = -1
        odds[node - n] = math.log(b / a)
        heapq.heappush(heap, (a + b, node))
    return up, side, odds


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, their numbers of rows, and the sums of these rows."""
    order = np.argsort(keys, kind="stable")
    first = _first(keys[order])
    return keys[order[first]], np.diff(np.append(first, len(keys))), _added(np.take(rows, order, axis=0), first)


def _first(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _added(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each first one to the next."""
    if len(rows) > 32 * len(first) > 0:  # long runs: row by row is faster
        return np.array([np.ones(len(x), x.dtype) @ x for x in np.split(rows, first[1:])])
    return np.add.reduceat(rows, first, axis=0) if len(first) else rows[:0]


def _exp_rows(x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Makes rows their exp, up to a factor a row, and returns a value of each row before that, and the rows' sums. Rows
    are shifted to their largest only if numbers would leave their range otherwise."""
    if x.max() > 60 or some.min() < -60:
        top = x.max(axis=1)
        x -= top[:, None]
        some = some - top
    np.exp(x, out=x)
    return some, x @ np.ones(x.shape[1], x.dtype)


class Attention:
    """One causal self-attention layer over classes, or over ids with weights of their own.

    A position looks at itself and the positions before it with weights exp(query . key + bias[distance]), and the next
    class has the logits own[class] + (weighted values) @ out. Queries, keys and values belong to classes; with `ids` each
    id adds its own, and the id is predicted within its class by the same weighted values.
    """

    NAMES = ("query", "key", "value", "bias", "out", "own")

    def __init__(self, p: dict[str, np.ndarray], ids: Ids | None = None):
        self.p, self.ids = p, ids
        self.end = END if ids is None else ids.end
        back = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self.back, self.mask = np.maximum(back, 0), back >= 0

    @classmethod
    def start(cls, pairs: np.ndarray, seed: int = 5) -> "Attention":
        """Begins as the smoothed pair statistics of the training texts."""
        rng = np.random.default_rng(seed)
        first = (pairs + pairs.sum(axis=0) / max(pairs.sum(), 1) * 5 + 0.01)
        draw = lambda *n: rng.normal(0, 0.1, n)
        return cls({"query": draw(CLASSES, WIDTH), "key": draw(CLASSES, WIDTH), "value": draw(CLASSES, WIDTH),
                    "bias": np.zeros(WINDOW), "out": draw(WIDTH, CLASSES),
                    "own": np.log(first / first.sum(axis=1, keepdims=True))})

    def gradients(self, seen: np.ndarray, ahead: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the valid positions of (windows, WINDOW) classes and the classes that follow them."""
        return self._learned(seen, ahead, valid)[:2]

    def _learned(self, seen: np.ndarray, ahead: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients, and the log10 probability of everything ahead. Gradients of ids are for some rows only:
        their numbers, how often each was met, and the gradients."""
        p, ids = self.p, self.ids
        at, ahead = seen.reshape(-1), ahead.reshape(-1)
        kinds, wanted = (at, ahead) if ids is None else (np.take(ids.of, at), np.take(ids.of, ahead))
        e = np.take(np.hstack([p["query"], p["key"], p["value"]]), kinds, axis=0)
        if ids is not None:
            e += np.take(ids.own, at, axis=0)
        e = e.reshape(*seen.shape, -1)
        q, k, v = e[:, :, :WIDTH], e[:, :, WIDTH:2 * WIDTH], e[:, :, 2 * WIDTH:]
        w = q @ k.transpose(0, 2, 1)
        w += np.where(self.mask, p["bias"][self.back], -1e9).astype(w.dtype)
        rows = w.reshape(-1, WINDOW)
        rows /= _exp_rows(rows, np.diagonal(w, axis1=1, axis2=2).reshape(-1))[1][:, None]
        h = (w @ v).reshape(-1, WIDTH)
        z = h @ p["out"]
        z += np.take(p["own"], kinds, axis=0)
        row, counts = np.arange(len(z)), valid.reshape(-1).astype(z.dtype)
        log_p, total = _exp_rows(z, z[row, wanted])
        log_p -= np.log(total)
        counts /= max(counts.sum(), 1)
        z *= (counts / total)[:, None]
        z[row, wanted] -= counts
        dh, g = z @ p["out"].T, {}
        if ids is not None:
            inside, some, back, g["id turn"] = ids.turns(h, ahead, counts)
            log_p += inside
            dh[some] += back
        loss = -(log_p * counts).sum()
        mean = np.einsum("ij,ij->i", dh, h).reshape(*seen.shape, 1)
        dh = dh.reshape(v.shape)
        dl = dh @ v.transpose(0, 2, 1)
        dl -= mean
        dl *= w
        de = np.empty_like(e)
        np.matmul(dl, k, out=de[:, :, :WIDTH])
        np.matmul(dl.transpose(0, 2, 1), q, out=de[:, :, WIDTH:2 * WIDTH])
        np.matmul(w.transpose(0, 2, 1), dh, out=de[:, :, 2 * WIDTH:])
        order = np.argsort(kinds.astype(np.int8) if ids is None else np.take(ids.rank, at), kind="stable")
        de, kinds = np.take(de.reshape(len(z), -1), order, axis=0), kinds[order]
        first = _first(kinds)
        met, own = kinds[first], _added(np.take(z, order, axis=0), first)
        if ids is not None:
            at = at[order]
            each = _first(at)
            de = _added(de, each)
            g["id own"] = at[each], np.diff(np.append(each, len(at))), de
            first = _first(kinds[each])
        by_class = np.zeros((CLASSES, CLASSES + 3 * WIDTH), z.dtype)
        by_class[met] = np.hstack([own, _added(de, first)])
        g |= dict(zip(("own", "query", "key", "value"), np.split(by_class, CLASSES + WIDTH * np.arange(3), axis=1)))
        by_place = (np.ones(len(dl), dl.dtype) @ dl.reshape(len(dl), -1)).reshape(WINDOW, WINDOW)
        g["out"], g["bias"] = h.T @ z, np.bincount(self.back[self.mask], by_place[self.mask], WINDOW)
        return loss, g, log_p.reshape(seen.shape) * (1 / math.log(10))

    def tables(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """The fitted model as tables: weights before normalisation by pair of classes, and by distance; with weights of ids,
    queries, keys and values of each."""

    def __init__(self, model: Attention):
        p, self.ids, self.end = model.p, model.ids, model.end
        if self.ids is None:
            pair = p["query"] @ p["key"].T
            self.pair = np.exp(pair - pair.max(axis=1, keepdims=True)).astype(np.float32).reshape(-1)
            self.far = np.where(model.mask, np.exp(p["bias"] - p["bias"].max())[model.back], 0.0).astype(np.float32)
            self.value = p["value"].astype(np.float32)
        else:
            self.each = (np.hstack([p[x] for x in ("query", "key", "value")])[self.ids.of] + self.ids.own).astype(np.float32)
            self.bias = np.where(model.mask, p["bias"][model.back], -1e9).astype(np.float32)
        self.out, self.own = (p[x].astype(np.float32) for x in ("out", "own"))

    def windows(self, seen: np.ndarray, ahead: np.ndarray, first: int) -> np.ndarray:
        """log10 probability of `ahead` at the positions from `first` on: masked attention, all windows at once."""
        kinds, ahead = seen[:, first:].reshape(-1), ahead[:, first:].reshape(-1)
        wanted = ahead
        if self.ids is None:
            w = np.take(self.pair, seen[:, first:, None] * CLASSES + seen[:, None, :], mode="clip")
            w *= self.far[first:]
            h = (w @ self.value[seen]).reshape(-1, WIDTH)
            h /= w.sum(axis=2).reshape(-1, 1)
        else:
            e = np.take(self.each, seen, axis=0)
            w = e[:, first:, :WIDTH] @ e[:, :, WIDTH:2 * WIDTH].transpose(0, 2, 1)
            w += self.bias[first:]
            total = _exp_rows(w.reshape(-1, WINDOW), np.diagonal(w[:, :, first:], axis1=1, axis2=2).reshape(-1))[1]
            h = (w @ e[:, :, 2 * WIDTH:]).reshape(-1, WIDTH)
            h /= total[:, None]
            kinds, wanted = np.take(self.ids.of, kinds), np.take(self.ids.of, ahead)
        z = h @ self.out
        z += np.take(self.own, kinds, axis=0)
        found, total = _exp_rows(z, z[np.arange(len(z)), wanted])
        found -= np.log(total)
        if self.ids is not None:
            found += self.ids.turns(h, ahead)
        return (found * np.float32(1 / math.log(10))).reshape(len(seen), -1)

    def texts(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of every class of the texts classes[start:end]; before a text's first class stands the end.

        Overlapping windows: the first of a text scores all its positions, each further one those after its overlap,
        so every class is scored once, and has at least OVERLAP classes of context where the text has them.
        """
        out = np.empty(len(classes))
        stride = WINDOW - OVERLAP
        lengths = ends - starts
        more = np.maximum(-(-(lengths - WINDOW) // stride), 0)
        before = np.concatenate([[self.end], classes[:-1]])
        before[starts] = self.end
        reach = np.arange(WINDOW)
        for first, begin, text in (
                (0, starts, np.arange(len(starts))),
                (OVERLAP, np.repeat(starts, more) + stride * (1 + _counted(more)), np.repeat(np.arange(len(starts)), more))):
            for a in range(0, len(begin), 256):
                at, own = begin[a:a + 256], text[a:a + 256]
                place = at[:, None] + reach
                inside = place < ends[own][:, None]
                place = np.minimum(place, len(classes) - 1)
                found = self.windows(before[place], classes[place], first)
                out[place[:, first:][inside[:, first:]]] = found[inside[:, first:]]
        return out


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Learner:
    """Adam over the windows of one shard, each of which is learned from; weights of ids move where they are met (Adagrad)."""

    def __init__(self, model: Attention, seed: int = 7):
        ids = model.ids and model.ids.with_weights(model.ids.own.copy(), model.ids.turn.copy())
        self.model = Attention({k: v.astype(np.float32) for k, v in model.p.items()}, ids)
        self.rng, self.m, self.s = np.random.default_rng(seed), {}, {}
        self.step = self.windows = 0
        self.squares = {x: np.zeros_like(getattr(ids, x)) for x in Ids.NAMES if ids}
        self.met = {x: np.zeros(len(v), np.int64) for x, v in self.squares.items()}

    def learn(self, seen: np.ndarray, ahead: np.ndarray, weight: np.ndarray, left: float) -> np.ndarray:
        """One step; the log10 probabilities of the classes ahead are those before it. `left`: share of steps to come."""
        _, g, log_p = self.model._learned(seen, ahead, weight)
        self.step += 1
        share, p = max(0.1, left), self.model.p
        for name in Ids.NAMES if self.model.ids else ():
            met, n, d = g.pop(f"id {name}")
            d = d * np.float32(weight.sum())
            self.met[name][met] += n
            squares = self.squares[name][met] + d * d
            self.squares[name][met] = squares
            getattr(self.model.ids, name)[met] -= np.float32(ID_RATE * share) * d / np.sqrt(squares + np.float32(ID_CALM ** 2))
        for name, d in g.items():
            d = d.astype(float)  # squares of small gradients are slow and inexact in 32 bits
            self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * d
            self.s[name] = 0.999 * self.s.get(name, 0) + 0.001 * d * d
            move = 0.02 * share * (self.m[name] / (1 - 0.9 ** self.step)) / (
                np.sqrt(self.s[name] / (1 - 0.999 ** self.step)) + 1e-8)
            p[name] = (p[name] - move).astype(np.float32)
        return log_p

    def texts(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, copies: np.ndarray, times: int = 1,
              steps: int = 0) -> np.ndarray:
        """Learns from every window of the texts, in mixed order; the log10 probability of every class before that.

        Positions weigh as many times as there are copies of their text. All is gone through `times` times. `steps` are
        about as many as the shard takes with texts still to come.
        """
        out = np.empty(len(classes))
        n = -(-(ends - starts) // WINDOW)
        text = np.repeat(np.arange(len(starts)), n)
        begin = starts[text] + WINDOW * _counted(n)
        before = np.concatenate([[self.model.end], classes[:-1]]).astype(np.int64)
        before[starts] = self.model.end
        self.windows += int((n * copies).sum())
        total = max(steps, self.step + times * -(-len(begin) // BATCH))
        for again in range(times):
            turn = self.rng.permutation(len(begin))
            for a in range(0, len(turn), BATCH):
                at = turn[a:a + BATCH]
                place = begin[at][:, None] + np.arange(WINDOW)
                valid = place < ends[text[at]][:, None]
                place = np.minimum(place, len(classes) - 1)
                log_p = self.learn(before[place], classes[place].astype(np.int64), valid * copies[text[at]][:, None],
                                   1 - 0.9 * self.step / total)
                if not again:
                    out[place[valid]] = log_p[valid]
        return out


def _layout(n_words: np.ndarray, words: np.ndarray, size: np.ndarray,
            flat: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts in a row with the end after each, where texts start and end, and which places are no ends.

    `words` are the texts' words as numbers; size and flat have each word's subwords.
    """
    first = np.cumsum(size) - size
    subwords = np.bincount(np.repeat(np.arange(len(n_words)), n_words), size[words], len(n_words)).astype(np.int64)
    ends = np.cumsum(subwords + 1)
    starts = ends - subwords - 1
    classes = np.full(int(ends[-1]), end, np.int64)
    place = np.ones(len(classes), bool)
    place[ends - 1] = False
    classes[place] = flat[np.repeat(first[words], size[words]) + _counted(size[words])]
    return classes, starts, ends, place


def _of_words(found: np.ndarray, words: np.ndarray, size: np.ndarray, within: np.ndarray) -> np.ndarray:
    """log10 probability of every word from those of its subwords' classes."""
    of_word = np.repeat(np.arange(len(words)), size[words])
    return np.bincount(of_word, found, len(words)) + within[words]


@dataclass
class Model:
    """What scoring needs in every task; its size is bounded by FREQUENT and the vocabulary."""

    vocabulary: bytes
    classes: np.ndarray
    inside: np.ndarray
    attention: Attention
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    share: float = 0.5

    @property
    def stored(self) -> type:
        """What classes, or ids with weights of their own, are stored as."""
        return np.int8 if self.attention.ids is None else np.uint16 if self.attention.end < 1 << 16 else np.uint32

    def known(self, words: list[bytes]) -> np.ndarray:
        """Counts of the frequent words among these, -1 for the others."""
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        found = np.full(len(words), -1, np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            found[hit] = self.counts[at[hit]]
        return found

    def mixed(self, log_p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of the mixture of both experts for words with these log10 probabilities by attention, and counts."""
        return np.log10(self.share * (count + 1.0) / (self.tokens + self.distinct + 1) + (1 - self.share) * 10.0 ** log_p)


def _frequent(counts: DataFrame, most: int) -> tuple[Column, pd.DataFrame]:
    """A threshold that at most `most` words reach, and those words' hashes and counts.

    The threshold is found from how many words have counts of each size class, never from an order of all words.
    """
    size = F.floor(F.log2(F.col("n")) * 4)
    by_size = counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect()
    least, held = None, 0
    for row in by_size:
        held += row["words"]
        if held > most:
            break
        least = row["size"]
    often = size >= least if least is not None else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashes = [xxh3_64_intdigest(w) for w in rows.column("word").to_pylist()]
            yield pa.record_batch([pa.array(np.array(hashes, np.uint64).view(np.int64)), rows.column("n")], names=["hash", "n"])

    return often, counts.where(often).mapInArrow(run, "hash long, n long").toPandas()


def _summed(docs: DataFrame, run, name: str) -> np.ndarray:
    """Sums of what the tasks yield as `key`, `n`, by key; the driver gets one number per key."""
    return _collected(docs.mapInArrow(run, "key int, n long"), name)


def _collected(keyed: DataFrame, name: str) -> np.ndarray:
    rows = written(keyed.groupBy("key").agg(F.sum("n").alias("n")), name).toPandas()
    out = np.zeros(int(rows["key"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["key"]] = rows["n"]
    return out


def _keyed(sums: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(sums)
    return pa.record_batch([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["key", "n"])


def count_pairs(tokens: DataFrame, model: Model) -> np.ndarray:
    """How often each class follows each other one in all texts; the end stands before and after a text."""
    of = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for lengths, numbers, sizes, ids in _numbers(batches, "lengths", "numbers", "sizes", "ids"):
            classes = _layout(lengths, numbers, sizes, of[ids])[0]
            before = np.concatenate([[END], classes[:-1]])
            pairs += np.bincount(before * CLASSES + classes, minlength=CLASSES * CLASSES)
        yield _keyed(pairs)

    found = _summed(tokens.select("lengths", "numbers", "sizes", "ids"), run, "lm-pairs")
    return np.pad(found, (0, CLASSES * CLASSES - len(found))).reshape(CLASSES, CLASSES)


def as_classes(tokens: DataFrame, model: Model) -> DataFrame:
    """`classes`, `edges`, `copies`: each different text of a slice as bytes of classes (of ids, where these have weights
    of their own), and per word what its unigram expert says over the probability within its classes, in hundredths of
    log10."""
    every, ids_too, kind = model.tokens + model.distinct + 1, model.attention.ids is not None, model.stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (w.values.to_pylist() for w in batch.column("dictionary"))
            for (lengths, numbers, sizes, ids), own in zip(_numbers([batch], "lengths", "numbers", "sizes", "ids"), words):
                edge = np.log10(np.maximum(model.known(own), 1) / every)
                if not ids_too:
                    edge -= np.bincount(np.repeat(np.arange(len(sizes)), sizes), model.inside[ids], len(sizes))
                edge = np.clip(np.rint(edge * 100), -32768, 32767).astype(np.int16)[numbers]
                flat = ids
                if not ids_too:
                    flat = model.classes[ids]
                    flat[np.cumsum(sizes) - sizes] += OPENS
                classes, starts, ends, _ = _layout(lengths, numbers, sizes, flat, model.attention.end)
                classes, last = classes.astype(kind), np.cumsum(lengths)
                found = Counter((classes[a:b].tobytes(), edge[c:d].tobytes()) for a, b, c, d in zip(
                    starts.tolist(), ends.tolist(), (last - lengths).tolist(), last.tolist()))
                yield pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary()),
                                       pa.array(list(found.values()), pa.int64())], names=["classes", "edges", "copies"])

    return tokens.select("dictionary", "lengths", "numbers", "sizes", "ids").mapInArrow(
        run, "classes binary, edges binary, copies long")


def _blocks(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[list[list]]:
    """Texts in blocks of about `most` bytes; equal texts stand together and become one with their number of copies."""
    texts: list[list] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("classes", "edges", "copies"))):
            if texts and texts[-1][:2] == list(row[:2]):
                texts[-1][2] += row[2]
                continue
            if held >= most:
                yield texts
                texts, held = [], 0
            texts.append(list(row))
            held += len(row[0])
    if texts:
        yield texts


_SHARDS = "key int, n long, part int, shard int, rows binary, met binary, weights binary"


def fit(tokens: DataFrame, model: Model, classes: int) -> tuple[Attention, float]:
    """The attention weights and the unigram expert's share from every window of all texts, `classes` classes in all.

    Texts go to shards by content and stand there in an order of their own, so weights do not depend on how the input is
    split. Each shard goes on from the model's weights over all its windows; the weights are averaged by the number of
    windows, those of single ids and turns by how often a shard met them. Copies of a text meet as one row with their
    number, which is their weight. Before a window is learned, its words are scored, so the share comes from probabilities
    that have not seen them; their counts are counted out, and words that the model does not hold stand as met once.
    """
    times = min(STEPS, max(1, -(-STEPS * BATCH * WINDOW // max(classes, 1))))
    by_id, kind, opens_word = model.attention.ids is not None, model.stored, Subwords(model.vocabulary).opens
    n_shards = max(1, -(-classes // (ID_SHARD if by_id else SHARD)))
    most = SHARD * np.dtype(kind).itemsize if by_id else math.inf
    steps = classes // (n_shards * WINDOW * BATCH) if n_shards > 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, ratios = Learner(model.attention), np.zeros(RATIOS, np.int64)
        for texts in _blocks(batches, most):
            marked = np.frombuffer(b"".join(t[0] for t in texts), kind)
            edges = np.frombuffer(b"".join(t[1] for t in texts), np.int16)
            size = np.array([len(t[0]) // marked.itemsize for t in texts], np.int64)
            n_words, copies = np.array([len(t[1]) // 2 for t in texts], np.int64), np.array([t[2] for t in texts], np.int64)
            del texts
            ends = np.cumsum(size)
            if by_id:
                log_p = learner.texts(marked, ends - size, ends, copies, times, steps)
                opens = np.append(opens_word, False)[marked]
            else:
                log_p, opens = learner.texts(marked % OPENS, ends - size, ends, copies, times, steps), marked >= OPENS
            log_p[ends - 1] = 0.0
            of_word = np.cumsum(opens) - 1
            ratio = edges / 100 - np.bincount(np.maximum(of_word, 0), log_p, max(len(edges), 1))[:len(edges)]
            at = np.clip((ratio + RATIO) * (RATIOS / (2 * RATIO)), 0, RATIOS - 1).astype(np.int64)
            ratios += np.bincount(at, np.repeat(copies, n_words), RATIOS).astype(np.int64)
        if not learner.windows:
            return
        weights = np.concatenate([learner.model.p[x].reshape(-1) for x in Attention.NAMES]).astype(float)
        sums = _keyed(np.concatenate([[learner.windows], ratios, np.rint(weights * learner.windows * PARTS).astype(np.int64)]))
        yield _shard_rows(sums.num_rows, key=sums.column("key"), n=sums.column("n"))
        shard = TaskContext.get().partitionId()
        for i, (name, met) in enumerate(learner.met.items()):
            own = getattr(learner.model.ids, name)
            for first in range(0, len(met), ID_PART):
                rows = first + np.flatnonzero(met[first:first + ID_PART])
                if len(rows):
                    yield _shard_rows(1, part=pa.array([(first // ID_PART << 1) + i], pa.int32()), shard=pa.array([shard], pa.int32()), **{
                        x: pa.array([v.tobytes()]) for x, v in (("rows", rows), ("met", met[rows]), ("weights", own[rows]))})

    shards = as_classes(tokens, model).repartition(n_shards, F.xxhash64("classes", "edges"))
    learned = written(shards.sortWithinPartitions("classes", "edges").mapInArrow(run, _SHARDS), "lm-shards")
    sums = _collected(learned.where("key IS NOT NULL").select("key", "n"), "lm-weights")
    if not len(sums) or not sums[0]:
        return model.attention, 0.5
    sums = np.pad(sums, (0, 1 + RATIOS + sum(p.size for p in model.attention.p.values()) - len(sums)))
    weights, at = sums[1 + RATIOS:] / (sums[0] * PARTS), 0
    p = {}
    for name in Attention.NAMES:
        like = model.attention.p[name]
        p[name], at = weights[at:at + like.size].reshape(like.shape), at + like.size
    return Attention(p, model.attention.ids and _averaged(learned, model.attention.ids)), fit_share(sums[1:1 + RATIOS])


def _shard_rows(height: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"key": pa.int32(), "n": pa.int64(), "part": pa.int32(), "shard": pa.int32(),
             "rows": pa.binary(), "met": pa.binary(), "weights": pa.binary()}
    return pa.record_batch([columns.get(x, pa.nulls(height, kind)) for x, kind in kinds.items()], names=list(kinds))


def _averaged(learned: DataFrame, ids: Ids) -> Ids:
    """The ids' weights averaged over the shards; rows that none has met stay. A part's shards are added one by one, in order."""
    width = [getattr(ids, x).shape[1] for x in Ids.NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, n = None, None, None

        def row() -> pa.RecordBatch:
            rows = np.flatnonzero(n)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([((part >> 1) * ID_PART + rows).tobytes()]),
                                    pa.array([(sums[rows] / n[rows, None]).astype(np.float32).tobytes()])],
                                   names=["part", "rows", "weights"])
        for batch in batches:
            for i, own in enumerate(batch.column("part").to_pylist()):
                if own != part:
                    if part is not None:
                        yield row()
                    part, sums, n = own, np.zeros((ID_PART, width[own & 1])), np.zeros(ID_PART, np.int64)
                rows, met = (np.frombuffer(batch.column(x)[i].as_py(), np.int64) for x in ("rows", "met"))
                rows = rows - (part >> 1) * ID_PART
                n[rows] += met
                sums[rows] += met[:, None] * np.frombuffer(batch.column("weights")[i].as_py(), np.float32).reshape(len(rows), -1)
        if part is not None:
            yield row()

    parts = learned.where("part IS NOT NULL").select("part", "shard", "rows", "met", "weights").repartition("part")
    own = [getattr(ids, x).copy() for x in Ids.NAMES]
    for r in parts.sortWithinPartitions("part", "shard").mapInArrow(run, "part int, rows binary, weights binary").collect():
        rows = np.frombuffer(r.rows, np.int64)
        own[r.part & 1][rows] = np.frombuffer(r.weights, np.float32).reshape(len(rows), -1)
    return ids.with_weights(*own)


def fit_share(ratios: np.ndarray, rounds: int = 8) -> float:
    """The unigram expert's share by expectation maximisation, from numbers of words by log10 of unigram over attention."""
    if not ratios.sum():
        return 0.5
    share, odds = 0.5, 10.0 ** ((np.arange(RATIOS) + 0.5) * (2 * RATIO / RATIOS) - RATIO)
    for _ in range(rounds):
        share = float((share * odds / (share * odds + 1 - share) * ratios).sum() / ratios.sum())
    return min(max(share, 0.01), 0.99)


def train(docs: DataFrame, vocabulary: bytes, frequent: int = FREQUENT, by_id: bool = False) -> tuple[Model, DataFrame]:
    """A model from all of `docs`, and the counts `word`, `n` of the words it does not hold itself.

    `docs` has `doc_id` and `text`, or is the table of tokenise(), of which it takes the rows with `learn`.
    Counts, classes, pair statistics, attention weights and the share cover every document, whatever its length. With
    `by_id` every subword id has weights of its own and is predicted from its context; without, the attention tells
    classes only, and an id has a fixed share of its class.
    """
    tokens = _tokens(docs, vocabulary).where("learn")
    counts = written(count_words(tokens), "lm-words")
    coder = Subwords(vocabulary)
    subwords = count_subwords(tokens, coder.size)
    of, inside = classes_of(subwords, count_company(tokens, subwords), coder)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = tokens.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
    often, held = _frequent(counts, frequent)
    order = np.argsort(held["hash"].to_numpy().view(np.uint64), kind="stable")
    model = Model(vocabulary, of, inside, Attention.start(np.zeros((CLASSES, CLASSES))),
                  held["hash"].to_numpy().view(np.uint64)[order], held["n"].to_numpy()[order],
                  int(sums[0]) + ends, int(sums[1]) + (ends > 0), ends)
    model.attention = Attention.start(count_pairs(tokens, model))
    if by_id:
        model.attention = Attention(model.attention.p, Ids(of, subwords))
    model.attention, model.share = fit(tokens, model, int(subwords.sum()) + ends)
    return model, counts.where(~often)


_SCORED = ("row long, doc_id long, n_tokens long, n_known long, base double, score double, "
           "others array<struct<word: binary, log_p: double>>")


def _score(model: Model):
    by_id = model.attention.ids is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, row = model.attention.tables(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, (n_words, words, sizes, ids) in enumerate(_numbers([batch], "lengths", "numbers", "sizes", "ids")):
                own, doc_ids = batch.column("dictionary")[i].values, batch.column("doc_ids")[i].values
                n = len(n_words)
                if by_id:
                    flat, within = ids, np.zeros(len(sizes))
                else:
                    flat = model.classes[ids]
                    within = np.bincount(np.repeat(np.arange(len(sizes)), sizes), model.inside[ids], len(sizes))
                c = model.known(own.to_pylist())[words]
                of_text = np.repeat(np.arange(n), n_words)
                classes, starts, ends, place = _layout(n_words, words, sizes, flat, model.attention.end)
                found = tables.texts(classes, starts, ends)
                log_p, at_end = _of_words(found[place], words, sizes, within), found[ends - 1]

                often = c >= 0
                base = np.bincount(of_text, np.log10(np.where(often, c, 0) + 1.0), n) + math.log10(model.ends + 1)
                score = np.bincount(of_text, np.where(often, model.mixed(log_p, c), 0.0), n)
                score += model.mixed(at_end, np.full(n, model.ends))
                n_known = np.bincount(of_text, often, n).astype(np.int64) + (model.ends > 0)
                rest = np.flatnonzero(~often)
                n_rest = np.bincount(of_text[rest], minlength=n)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n_rest)]).astype(np.int32)),
                    pa.StructArray.from_arrays([own.take(pa.array(words[rest])), pa.array(log_p[rest])], ["word", "log_p"]))
                rows = np.arange(row, row + n)
                row += n
                yield pa.record_batch([pa.array(rows), doc_ids, pa.array(n_words + 1), pa.array(n_known),
                                       pa.array(base), pa.array(score), lists],
                                      names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "others"])
    return run


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """`doc_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every whole text.

    `score` is the log10 probability of the text: each word's is a mixture of two experts, its subwords by attention
    (the class of each after those before it, and the subword within its class) and its count in training; the
    end counts as a word. `base_score` is the unigram score alone, with one added to every count. Counts of frequent
    words are in the model; occurrences of the others, which no task can hold all of, are joined with their counts by
    a shuffle on the word.

    Null text is empty: one token, the end. Equal doc_ids are separate rows. Without training documents every token is
    unknown. No rows give no rows. `docs` may be the table of tokenise(), of which it takes all rows.
    """
    tokens = _tokens(docs, model.vocabulary).select("doc_ids", "dictionary", "lengths", "numbers", "sizes", "ids")
    first = written(tokens.mapInArrow(_score(model), _SCORED), "lm-scored")
    single = first.select("row", F.explode_outer("others").alias("_w")).where("_w IS NOT NULL").select(
        "row", F.col("_w.word").alias("_word"), F.col("_w.log_p").alias("_log_p"))
    n, every = F.coalesce("n", F.lit(0)), float(model.tokens + model.distinct + 1)
    mixed = F.log10(F.lit(model.share / every) * (n + 1.0) + F.lit(1 - model.share) * F.pow(F.lit(10.0), F.col("_log_p")))
    found = single.join(rare, F.col("_word") == F.col("word"), "left").groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.log10(n + 1.0)).alias("more"), F.count("n").alias("n_more"), F.sum(mixed).alias("more_score"))
    return first.join(found, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("n_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(every))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
