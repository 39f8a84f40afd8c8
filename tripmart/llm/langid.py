"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.hashing import rows_of
from tripmart.llm.text import column, drawn, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The bounded sample a language is learned from: documents, none longer than so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 20_000
ROUNDS = 3
#: A text is in no learned language if its log probability per letter is so many spreads below the mean of the words that
#: its language was learned from; few words stray further, by STRAY over the root of their number.
SPREADS, STRAY = 3.0, 3.0
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]{1,32}")
_START = "▁"
_LONGEST = 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Probability of a character that no piece covers.
_RARE = 1e-7
_CACHED_WORDS = 200_000


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a public vocabulary that consist of letters, with the mark of a word's start or without."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for n in names if 0 < len(p := n.lower()) <= _LONGEST and (p == _START or p.removeprefix(_START).isalpha())})


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case; runs above 32 letters are cut, nothing is left out."""
    return _LETTERS.findall(text.lower()) if text else []


class Lattice:
    """All pieces in all places of a list of words (longest first), and sums over the paths through them."""

    def __init__(self, words: list[str], index: dict[int, tuple[np.ndarray, np.ndarray]], n_pieces: int):
        marked = [_START + w for w in words]
        self.order = np.argsort([-len(m) for m in marked], kind="stable")
        marked = [marked[i] for i in self.order]
        self.lengths = np.array([len(m) for m in marked], np.int64)
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(len(chars))
        self.none, self.rare = n_pieces, n_pieces + 1
        self.pieces, rolled = [], np.zeros(len(chars), np.uint64)
        for size in range(1, _LONGEST + 1):
            if size > len(chars):
                self.pieces.append(np.full(len(chars), self.none, np.int32))
                continue
            rolled[:len(chars) - size + 1] = rolled[:len(chars) - size + 1] * _STEP + chars[size - 1:] + np.uint64(1)
            at = np.full(len(chars), self.none, np.int32)
            if size in index:
                hashes, ids = index[size]
                place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
                hit = (hashes[place] == rolled) & (left >= size)
                at[hit] = ids[place[hit]]
            if size == 1:
                at[at == self.none] = self.rare
            self.pieces.append(at)
        #: words at least t long are the first active[t]
        self.active = [int(np.searchsorted(-self.lengths, -t, "right")) for t in range(int(self.lengths.max()) + 1)]

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """alpha[t][word, language]: probability of the first t characters, summed over all segmentations.

        32 characters of the rarest kind keep it within the range of doubles.
        """
        alpha = [np.ones((len(self.lengths), p.shape[1]))]
        for t in range(1, len(self.active)):
            n = self.active[t]
            total = np.zeros((n, p.shape[1]))
            for size in range(1, min(t, _LONGEST) + 1):
                total += alpha[t - size][:n] * p[self.pieces[size - 1][self.starts[:n] + t - size]]
            alpha.append(total)
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, in the order the words were given."""
        alpha, out = self.forward(p), np.empty((len(self.lengths), p.shape[1]))
        ends = np.stack([alpha[n][i] for i, n in enumerate(self.lengths)])
        out[self.order] = np.log(ends)
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, on average over all segmentations, for words with these counts."""
        alpha, used = self.forward(p), np.zeros_like(p)
        counts, longest = counts[self.order], len(self.active) - 1
        beta: list[np.ndarray | None] = [None] * (longest + 1)
        for t in range(longest, -1, -1):
            n = self.active[t]
            total = (self.lengths[:n] == t).astype(float)[:, None] * np.ones((1, p.shape[1]))
            for size in range(1, min(longest - t, _LONGEST) + 1):
                m = self.active[t + size]
                total[:m] += p[self.pieces[size - 1][self.starts[:m] + t]] * beta[t + size][:m]
            beta[t] = total
        weight = counts / np.maximum(beta[0], 1e-300)
        for t in range(longest):
            for size in range(1, min(longest - t, _LONGEST) + 1):
                m = self.active[t + size]
                ids = self.pieces[size - 1][self.starts[:m] + t]
                share = alpha[t][:m] * p[ids] * beta[t + size][:m] * weight[:m]
                for k in range(p.shape[1]):
                    used[:, k] += np.bincount(ids, share[:, k], len(p))
        return used


def piece_index(pieces: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, piece in enumerate(pieces):
        rolled = 0
        for c in piece:
            rolled = (rolled * int(_STEP) + ord(c) + 1) & ((1 << 64) - 1)
        by_size.setdefault(len(piece), []).append((rolled, i))
    return {n: (np.array([h for h, _ in sorted(rows)], np.uint64), np.array([i for _, i in sorted(rows)], np.int32))
            for n, rows in by_size.items()}


@dataclass
class Model:
    """Languages in order, log priors, and piece probabilities (a row per piece, then no piece, then a rare character)."""

    langs: list[str]
    prior: np.ndarray
    pieces: list[str]
    p: np.ndarray
    #: Mean and spread of the log probability of a letter, by language; None: no text is judged by it.
    usual: np.ndarray | None = None
    _index: dict | None = field(default=None, repr=False)

    def likelihood(self, words: list[str]) -> np.ndarray:
        if self._index is None:
            self._index = piece_index(self.pieces)
        return Lattice(words, self._index, len(self.pieces)).likelihood(self.p)

    def is_usual(self, lang: int, per_letter: float, n_words: int) -> bool:
        """Whether a text with this mean log probability per letter can be in a learned language."""
        if self.usual is None:
            return True
        mean, spread = self.usual[:, lang]
        return bool(per_letter >= mean - spread * (SPREADS + STRAY / np.sqrt(n_words)))


def fit_pieces(words: list[str], counts: np.ndarray, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities per language by expectation maximisation; `counts` has a row per word, a column per language.

    Every language leans on what all together use, and that on a floor for every piece, so nothing has probability 0.
    """
    lattice, n_langs = Lattice(words, piece_index(pieces), len(pieces)), counts.shape[1]
    p = np.full((len(pieces) + 2, n_langs), 1.0 / len(pieces))
    p[-2], p[-1] = 0.0, _RARE
    for _ in range(rounds):
        used = lattice.expected(p, counts)[:-2]
        together = used.sum(axis=1) + 0.01
        together /= together.sum()
        p[:-2] = (used + 1000.0 * together[:, None]) / (used.sum(axis=0) + 1000.0)
    return p


def train(docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
          rounds: int = ROUNDS) -> Model:
    """A model from labelled documents (`doc_id`, `text`, `lang`): priors count all of them, pieces a bounded sample.

    The sample takes, per language, the `sample_docs` documents with the smallest drawn number among those of at
    most `sample_chars` characters (all rows are looked at; `sample_docs` bounds what is learned from). Word counts of
    the sample meet in one task; the driver gets one number per piece and language.
    """
    known = docs.where("lang IS NOT NULL")
    priors = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    if not langs:
        return Model([], np.zeros(0), pieces, np.zeros((len(pieces) + 2, 0)))
    # Only about four times the sample is put in order, however many documents there are.
    share = F.create_map(*[F.lit(x) for lang, n in priors.items() for x in (lang, min(1.0, 4 * sample_docs / n))])
    near = known.where((F.length("text") <= sample_chars) & (drawn(F.col("doc_id")) < share[F.col("lang")]))
    nearest = Window.partitionBy("lang").orderBy(drawn(F.col("doc_id")), "doc_id")
    chosen = near.select("doc_id", "lang").withColumn("_place", F.row_number().over(nearest)).where(F.col("_place") <= sample_docs)
    # at most `sample_docs` rows per language
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")))
    sample = known.join(chosen, F.expr("doc_id = _id AND lang = _lang"), "left_semi").where(
        F.length("text") <= sample_chars).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            lists = rows["text"].map(letters)
            yield pd.DataFrame({"lang": rows["lang"], "word": lists}).explode("word").dropna().value_counts().reset_index()

    counted = sample.mapInPandas(count, "lang string, word string, count long").groupBy("word").pivot(
        "lang", langs).agg(F.sum("count"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames)
        p = fit_pieces(list(rows["word"]), rows.iloc[:, 1:].fillna(0.0).to_numpy(float), pieces, rounds)
        counts = rows.iloc[:, 1:].fillna(0.0).to_numpy(float)
        out = np.concatenate([p, usual_letters(list(rows["word"]), counts, Model(langs, np.zeros(len(langs)), pieces, p))])
        yield pd.DataFrame({"piece": np.repeat(np.arange(len(out)), len(langs)), "lang": np.tile(np.arange(len(langs)), len(out)),
                            "p": out.reshape(-1)})

    fitted = written(counted.coalesce(1).mapInPandas(fit, "piece int, lang int, p double"), "langid-model").toPandas()
    p = np.full((len(pieces) + 4, len(langs)), _RARE)
    p[-4] = 0.0
    p[fitted["piece"], fitted["lang"]] = fitted["p"]
    total = sum(priors.values())
    return Model(langs, np.log([priors[x] / total for x in langs]), pieces, p[:-2], p[-2:] if len(fitted) else None)


def usual_letters(words: list[str], counts: np.ndarray, model: Model) -> np.ndarray:
    """Mean and spread per language of a word's log probability per letter (a word's start counts as one)."""
    sizes, found = np.array([len(w) + 1.0 for w in words]), model.likelihood(words)
    mean = (counts * found).sum(axis=0) / np.maximum(counts.T @ sizes, 1.0)
    apart = (found / sizes[:, None] - mean) ** 2
    return np.stack([mean, np.sqrt((counts * apart).sum(axis=0) / np.maximum(counts.sum(axis=0), 1.0))])


def _predict(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table, sizes = np.empty((0, len(model.langs))), np.empty(0)
        for rows in rows_of(batches):
            texts = [letters(t.as_py()) for t in rows.column(at)]
            texts = [t if any(c.isalpha() for w in t for c in w) else [] for t in texts]
            if len(known) > _CACHED_WORDS:
                known, table, sizes = {}, np.empty((0, len(model.langs))), np.empty(0)
            fresh = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in known]
            if fresh and model.langs:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                table = np.concatenate([table, model.likelihood(fresh)])
                sizes = np.concatenate([sizes, [len(w) + 1.0 for w in fresh]])
            langs, scores, usual = [], [], []
            for t in texts:
                if not t or not model.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    usual.append(False)
                    continue
                at_word = np.fromiter(map(known.__getitem__, t), np.int64, len(t))
                found = table[at_word].sum(axis=0)
                total = model.prior + found
                best = int(total.argmax())
                usual.append(model.is_usual(best, found[best] / sizes[at_word].sum(), len(t)))
                langs.append(model.langs[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.record_batch([*[c for i, c in enumerate(rows.columns) if i != at], pa.array(langs, pa.string()),
                                   pa.array(scores, pa.float64()), pa.array(usual, pa.bool_())],
                                  names=[*[n for i, n in enumerate(rows.schema.names) if i != at], "lang_pred", "score", "usual"])
    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `lang_pred`, `score` (posterior probability) of every whole text, from the text alone.

    Null texts and texts without a letter are `und` with score 0, as is every text if no language was learned. Ties
    go to the first language by code point.
    """
    cols = [*[column(docs, c).alias(f"k{i}") for i, c in enumerate(keep)], column(docs, "text").alias("text")]
    rows = docs.select(*cols)
    schema = ", ".join([*[f"{n} {t}" for n, t in rows.dtypes[:-1]], "lang_pred string", "score double", "usual boolean"])
    out = rows.mapInArrow(_predict(model, len(keep)), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def rejected(lang_pred: Column, score: Column, least: float) -> Column:
    return (lang_pred == UNKNOWN) | (score < least)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents in one of the learned languages, columns as they are.

    The language must be told with a posterior of `least`. A posterior compares the learned languages alone, so the whole
    text must also be about as probable, letter by letter, as the texts its language was learned from (`Model.is_usual`).
    """
    # by number: names may hold dots
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).select("*", F.col(names[docs.columns.index("text")]).alias("text"))
    schema = ", ".join([*[f"{n} {t}" for n, t in plain.dtypes[:-1]], "lang_pred string, score double, usual boolean"])
    out = plain.mapInArrow(_predict(model, len(names)), schema)
    return out.where(~rejected(F.col("lang_pred"), F.col("score"), least) & F.col("usual")).select(*names).toDF(*docs.columns)
