"""License scans: k-gram matches between texts and templates vote for diagonals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripmart.llm.text import NOT_ALNUM, column, free_names, gram_hashes, lower_ascii, row_key, words, written


@dataclass(frozen=True)
class Template:
    """A wording and its label. Base templates count only word for word."""

    label: str
    text: str
    base: bool = False


# Phrases, and sentences of well-known licences, in lower case without punctuation.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words of a k-gram; shorter templates are one gram.
GRAM = 3
#: Matches on diagonals up to this far apart belong together: words put in or left out move a match sideways.
DRIFT = 3
#: Share of a template's words that must be found for its label.
COVERAGE = 0.8


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """A row per gram of the fixed templates: `_template`, `label`, `base`, `_len`, `_k`, `_place`, `_gram`, `_text`."""
    rows = [(i, t.label, t.base, t.text) for i, t in enumerate(templates)]
    df = spark.createDataFrame(rows, "_template int, label string, base boolean, _phrase string")
    df = df.withColumn("_words", F.split("_phrase", " ")).withColumn("_len", F.size("_words"))
    out = None
    for k in sorted({min(GRAM, len(t.text.split())) for t in templates}):
        grams = df.where(F.least(F.col("_len"), F.lit(GRAM)) == k).select(
            "*", F.lit(k).alias("_k"), F.posexplode(gram_hashes(F.col("_words"), k)).alias("_place", "_gram")).select(
            "_template", "label", "base", "_phrase", "_len", "_k", "_place", "_gram",
            F.array_join(F.slice("_words", F.col("_place") + 1, F.col("_k")), " ").alias("_text"))
        out = grams if out is None else out.unionByName(grams)
    return out


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified spans: `_key`, `label`, `base`, `first_word`, `last_word`, `coverage`.

    `docs` has `_key` and `_words`. All rolling grams of the texts are joined with the few grams of the fixed
    templates (broadcast: their number is that of the templates). A match at text word p and template word q lies
    on diagonal p - q. Matching words are compared, not only hashes. A base template must match whole on one
    diagonal. Else, diagonals at most DRIFT apart are merged, and the share of the template's words that they cover
    together must reach COVERAGE. The text's words stay beside the grams in one stage and are read only for matches.
    """
    spark = docs.sparkSession
    wanted = template_grams(spark, templates)
    ks = sorted({min(GRAM, len(t.text.split())) for t in templates})

    def placed(k: int) -> Column:
        return F.transform(gram_hashes(F.col("_words"), k),
                           lambda h, i: F.struct(F.lit(k).alias("_k"), i.alias("_at"), h.alias("_gram")))

    hashed = docs.withColumn("_grams", F.concat(*[placed(k) for k in ks]))
    flat = hashed.select("_key", "_words", F.explode_outer("_grams").alias("_g")).select(
        "_key", "_words", F.col("_g._k").alias("_k"), F.col("_g._at").alias("_at"), F.col("_g._gram").alias("_gram"))
    joined = flat.join(F.broadcast(wanted), ["_k", "_gram"]).where(
        F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_k")), " ") == F.col("_text"))
    # Both kinds of spans are read from the votes. They are few, so writing them spares a second pass over the texts.
    votes = written(joined.select("_key", "_template", "label", "base", "_len", "_k", "_place",
                          (F.col("_at") - F.col("_place")).alias("_diagonal")).groupBy(
        "_key", "_template", "label", "base", "_len", "_k", "_diagonal").agg(
        F.collect_set("_place").alias("_places")), "licenses-votes")

    exact = votes.where(F.col("base") & (F.size("_places") == F.col("_len") - F.col("_k") + 1)).select(
        "_key", "label", "base", F.col("_diagonal").alias("first_word"),
        (F.col("_diagonal") + F.col("_len") - 1).alias("last_word"), F.lit(1.0).alias("coverage"))

    along = Window.partitionBy("_key", "_template").orderBy("_diagonal")
    apart = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(along) > DRIFT, F.lit(True))
    merged = votes.where(~F.col("base")).withColumn("_new", apart.cast("int")).withColumn(
        "_cluster", F.sum("_new").over(along))
    covered = F.array_distinct(F.flatten(F.transform(
        F.flatten(F.collect_list("_places")), lambda q: F.sequence(q, q + F.col("_k") - 1))))
    loose = merged.groupBy("_key", "_template", "label", "base", "_len", "_k", "_cluster").agg(
        covered.alias("_covered"),
        F.min(F.col("_diagonal") + F.array_min("_places")).alias("first_word"),
        F.max(F.col("_diagonal") + F.array_max("_places")).alias("_last")).select(
        "_key", "label", "base", "first_word", (F.col("_last") + F.col("_k") - 1).alias("last_word"),
        (F.size("_covered") / F.col("_len")).alias("coverage")).where(F.col("coverage") >= COVERAGE)
    return exact.unionByName(loose)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The columns of `docs`, and what licences each text names.

    `n_words`; `n_base`, `first_word`, `last_word`: number, smallest and largest start of base phrases;
    `base_labels`, `labels`: arrays of distinct sorted labels; `score`: the largest covered share of a template with
    a label, 0 without. Null text has no words. Equal rows get equal results. Clashing columns of `docs` keep their
    names: the new ones get an underscore in front.
    """
    names = free_names(docs, "_key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    key, n_words, n_base, first, last, base_labels, labels, score = names
    at = row_key(docs["doc_id"], docs["text"])
    spans = matches(docs.select(at.alias("_key"), words(lower_ascii(docs["text"]), NOT_ALNUM).alias("_words")), templates)
    # Rows of one key have one text: each of their spans is there once per row, which distinct() takes back.
    per_doc = spans.distinct().groupBy("_key").agg(
        F.count_if("base").alias(n_base),
        F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias(first),
        F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias(last),
        F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias(base_labels),
        F.sort_array(F.collect_set("label")).alias(labels),
        F.max("coverage").alias(score)).withColumnRenamed("_key", key)
    here = docs.select(*[column(docs, c) for c in docs.columns],
                       F.size(words(docs["text"], r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias(n_words),
                       at.alias(key))
    none = F.array().cast("array<string>")
    return here.join(per_doc, key, "left").select(
        *[column(here, c) for c in [*docs.columns, n_words]],
        F.coalesce(column(per_doc, n_base), F.lit(0)).alias(n_base), column(per_doc, first), column(per_doc, last),
        F.coalesce(column(per_doc, base_labels), none).alias(base_labels),
        F.coalesce(column(per_doc, labels), none).alias(labels),
        F.coalesce(column(per_doc, score), F.lit(0.0)).alias(score))
