"""The stages one after the other on the small tables."""

import itertools
import re

import corpus_pipeline
from tripmart.llm import langid, queries
from tripmart.llm.hashing import spaced_words
from tripmart.llm.text import written


def first_of_groups(texts, percent):
    """The smallest id of each group that links of `percent` of five-word shingles make, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        words = spaced_words(t)
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    first = {i: i for i in texts}

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            first[y] = x
    return {i for i in texts if first[i] == i}


FOREIGN = ["La rapida bruna vulpo saltas super la mallaborema hundo kaj kuras en la arbaron", "快速的棕色狐狸跳过懒狗并跑进森林",
           "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee",
           "xq zrt vbnm qwpl kjhg zzxv"]


def test_language_stage_rejects_foreign_texts_and_keeps_held_out_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.train(docs.where("doc_id % 3 <> 1"), langid.read_pieces())
    foreign = spark.createDataFrame([(-i, t, None, None, 1) for i, t in enumerate([*FOREIGN, *FOREIGN, " ".join(FOREIGN) * 50], 1)],
                                    docs.schema)
    assert langid.keep_known(foreign, model).count() == 0
    held_out = docs.where("doc_id % 3 = 1 AND lang IS NOT NULL AND text RLIKE '[a-zA-Z]'")
    assert langid.keep_known(held_out, model).count() >= 0.99 * held_out.count() > 200
    added = docs.unionByName(foreign)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, added, sf_dir).select("doc_id").collect()}
    assert not any(i < 0 for i in kept) and len(kept) >= 0.99 * docs.count()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, sf_dir), f"test-{name}")
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() == len(after)
        seen[name], docs = (before, after), out
    before, after = seen["near_duplicates"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert after == first_of_groups({i: text[i] for i in before}, 80)
    assert docs.columns == [*columns, "copy"]


def test_pipeline_query(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op1_langid"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_no_local_checkpoint():
    for module in (langid, queries, corpus_pipeline):
        assert not re.search("localCheckpoint", open(module.__file__).read())
