"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.text import NOT_ALNUM, column, free_names, gram_hashes, lower_ascii, row_key, words, written

#: The shortest shared run of words that must be found.
SHARED = 10
#: Words of a k-gram. A run of SHARED words holds SHARED - GRAM + 1 of them: the length of the sliding window.
GRAM = 5
#: Fingerprints or windows up to this number are broadcast (at most about 100 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_LOW = 20  # bits of a position kept beside a hash


def winnow(hashes, window: int):
    """Positions whose hash is the smallest of some `window` neighbouring ones (leftmost first).

    Each hash gives up its low bits to its position modulo 2^20, so that one minimum gives hash and place; the full
    place follows from where the window starts. Arrays shorter than the window give no position.
    """
    low = (1 << _LOW) - 1
    packed = F.transform(hashes, lambda h, i: F.shiftleft(h, _LOW).bitwiseOR((i.cast("long")).bitwiseAND(F.lit(low))))
    return packed, lambda p: F.array_distinct(F.transform(
        F.slice(p, 1, F.greatest(F.size(p) - (window - 1), F.lit(0))),
        lambda _, i: i + F.pmod(F.array_min(F.slice(p, i + 1, window)).bitwiseAND(F.lit(low)).cast("int") - i,
                                F.lit(1 << _LOW))))


def _fingerprints(df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, `_words`, and a row per winnowed k-gram: `_at` (its first word), `_gram` (its hash)."""
    hashed = df.withColumn("_hashes", gram_hashes(F.col("_words"), GRAM))
    packed, places = winnow(F.col("_hashes"), SHARED - GRAM + 1)
    placed = hashed.withColumn("_packed", packed).withColumn("_places", places(F.col("_packed")))
    # explode() would have its filter on empty arrays pushed down, which computes the arrays once per element
    return placed.select(*keep, "_words", "_hashes", F.explode_outer("_places").alias("_at")).select(
        *keep, "_words", "_at", F.get("_hashes", F.col("_at")).alias("_gram"))


def _all_grams(df: DataFrame, keep: list[str], k: int) -> DataFrame:
    hashed = df.withColumn("_hashes", gram_hashes(F.col("_words"), k))
    return hashed.select(*keep, "_words", F.posexplode_outer("_hashes").alias("_at", "_gram"))


def item_windows(items: DataFrame) -> DataFrame:
    """`item_id`, `_window` (words joined by a space), `_n` (their number): every run of SHARED words of an item.

    An item of fewer words is one window; one without words, or null, has none.
    """
    found = items.select(items["item_id"].cast("string").alias("item_id"),
                         words(lower_ascii(items["text"]), NOT_ALNUM).alias("_words")).where(F.size("_words") > 0)
    n = F.least(F.size("_words"), F.lit(SHARED))
    starts = F.explode(F.sequence(F.lit(0), F.size("_words") - n))
    return found.select("item_id", "_words", n.alias("_n"), starts.alias("_at")).select(
        "item_id", F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_n")), " ").alias("_window"), "_n").distinct()


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document text that holds a window: `_key`, `n_hit`, `item_ids` (sorted strings).

    `docs` has `_key` and `_words`; rows of one key have one text. Both sides keep the smallest k-gram hash of every
    SHARED - GRAM + 1 neighbours, so a shared run of SHARED words always shares a fingerprint, whatever its place.
    Only documents' winnowed grams are joined, with the items' winnowed grams; each match is then extended: all runs
    of SHARED words around it are compared word by word with the items' windows. Items shorter than SHARED words are
    looked for by all grams of just their length.
    """
    windows = written(item_windows(items), "decontaminate-windows")
    small = windows.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    item_words = windows.select("_window", "_n", F.split("_window", " ").alias("_words"))
    long_grams = _fingerprints(item_words.where(F.col("_n") == SHARED), []).select("_gram").distinct()
    lengths = sorted(r[0] for r in windows.where(F.col("_n") < SHARED).select("_n").distinct().collect())  # at most 9

    def matched(grams: DataFrame, wanted: DataFrame) -> DataFrame:
        if small:
            return grams.join(F.broadcast(wanted), "_gram", "left_semi")
        # A shuffle must not carry whole texts: join places first, then fetch the words of the documents they are in.
        places = grams.select("_key", "_at", "_gram").join(wanted, "_gram", "left_semi").select("_key", "_at").distinct()
        of_doc = places.groupBy("_key").agg(F.collect_list("_at").alias("_ats"))
        return docs.join(of_doc, "_key").select("_key", "_words", F.explode("_ats").alias("_at"))

    first = F.greatest(F.col("_at") - (SHARED - GRAM), F.lit(0))
    last = F.least(F.col("_at"), F.size("_words") - SHARED)
    around = matched(_fingerprints(docs, ["_key"]), long_grams).where(last >= first).select(
        "_key", "_words", F.explode(F.sequence(first, last)).alias("_at"), F.lit(SHARED).alias("_n"))
    for n in lengths:
        wanted = _all_grams(item_words.where(F.col("_n") == n), [], n).select("_gram").distinct()
        around = around.unionByName(matched(_all_grams(docs, ["_key"], n), wanted).select(
            "_key", "_words", "_at", F.lit(n).alias("_n")))
    spans = around.select("_key", "_at", "_n",
                          F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_n")), " ").alias("_window"))
    found = spans.join(hint(windows.select("_window").distinct()), "_window", "left_semi").distinct()
    found = written(found, "decontaminate-spans")

    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("_at", "_n"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda done, s: F.struct(F.greatest(done["end"], s["_at"] + s["_n"]).alias("end"),
                                 (done["n"] + F.greatest(s["_at"] + s["_n"] - F.greatest(done["end"], s["_at"]), F.lit(0))).alias("n")),
    )["n"].cast("long")
    per_doc = found.groupBy("_key").agg(covered.alias("n_hit"))
    of_items = found.select("_key", "_window").distinct().join(
        hint(windows.select("_window", "item_id")), "_window").groupBy("_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return per_doc.join(of_items, "_key")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of `docs`, and `n_words`, `n_hit`, `item_ids`: words inside a window of an item, and those items.

    Null text has no words and no hits. Equal rows get equal results; an item id that is null or repeated counts as
    none or once. Without items nothing is hit. Clashing columns of `docs` keep their names: the new ones get an
    underscore in front.
    """
    key, n_words, n_hit, ids = free_names(docs, "_key", "n_words", "n_hit", "item_ids")
    at = row_key(docs["doc_id"], docs["text"])
    found = hits(docs.select(at.alias("_key"), words(lower_ascii(docs["text"]), NOT_ALNUM).alias("_words")), items)
    found = found.select(F.col("_key").alias(key), F.col("n_hit").alias(n_hit), F.col("item_ids").alias(ids))
    here = docs.select(*[column(docs, c) for c in docs.columns],
                       F.size(words(docs["text"], r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias(n_words),
                       at.alias(key))
    return here.join(found, key, "left").select(
        *[column(here, c) for c in [*docs.columns, n_words]],
        F.coalesce(column(found, n_hit), F.lit(0)).alias(n_hit),
        F.coalesce(column(found, ids), F.array().cast("array<string>")).alias(ids))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, columns as they are. Cases as in `contamination`."""
    (key,) = free_names(docs, "_key")
    at = row_key(docs["doc_id"], docs["text"])
    found = hits(docs.select(at.alias("_key"), words(lower_ascii(docs["text"]), NOT_ALNUM).alias("_words")), items)
    here = docs.withColumn(key, at)
    return here.join(found.select(F.col("_key").alias(key)), key, "left_anti").select(
        *[column(here, c) for c in docs.columns])
