"""Language, near duplicates, sentence spans, substrings, chunks, scores and archives against brute force."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tripmart.llm import chunks, components, hashing, langid, lm, neardup, sentences, substrings, suffixes, warc


# language -----------------------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab", "ba"]
    p = np.array([[0.1], [0.2], [0.15], [0.05], [0.3], [0.02], [0.07], [0.0], [1e-7]])
    of = dict(zip(pieces, p[:, 0]))

    def brute(s):
        if not s:
            return 1.0
        return sum((of.get(s[:n], 1e-7 if n == 1 else 0.0)) * brute(s[n:]) for n in range(1, len(s) + 1))

    words = ["a", "ab", "abba", "bab", "cab", "babab"]
    lattice = langid.Lattice(words, langid.piece_index(pieces), len(pieces))
    assert np.allclose(lattice.likelihood(p)[:, 0], [math.log(brute("▁" + w)) for w in words])


def test_expectation_raises_likelihood():
    pieces, words = ["▁", "a", "b", "ab", "▁ab"], ["ab", "abab", "b"]
    counts = np.array([[5.0, 0], [3, 1], [0, 9]])
    lattice, scores = langid.Lattice(words, langid.piece_index(pieces), len(pieces)), []
    for rounds in (1, 2, 5):
        p = langid.fit_pieces(words, counts, pieces, rounds)
        assert np.allclose(p[:-2].sum(axis=0), 1)
        scores.append((lattice.likelihood(p) * counts).sum())
    assert scores == sorted(scores)


def test_language(spark, docs, no_docs):
    rows = [(i, " ".join(random.Random(i).choices(words, k=12)), lang) for i in range(120)
            for lang, words in [(("en", ["the", "house", "with", "thing"]), ("de", ["das", "haus", "mit", "ding"]))[i % 2]]]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled.where("doc_id < 80"), langid.read_pieces())
    out = langid.predict(labelled, model).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0.5 < r.score <= 1 for r in out)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in r.text or "") for r in docs.collect())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in r.text) for r in kept.collect())
    nothing = langid.train(labelled.withColumn("lang", langid.F.lit(None).cast("string")), langid.read_pieces())
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


# near duplicates ----------------------------------------------------------------------------------------------------

def brute_components(rows, k=5, percent=85):
    sets = []
    for _, text in rows:
        w = hashing.spaced_words(text)
        n = min(k, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            head[find(a)] = find(b)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return [(doc_id, len(sets[i]), min(least[find(i)], default=None)) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize("leaders", [neardup.LEADERS, 1])
def test_near_duplicates(spark, docs, leaders):
    rng = random.Random(8)
    family, rows = [f"w{rng.randrange(50)}" for _ in range(120)], [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(40):
        copy = list(family)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        rows.append((1000 - i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, leaders=leaders).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows))
    assert all(r["kept"] == (r.doc_id == r.component_id) for r in got)


def test_first_of_each(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(t for (i, t), (_, _, c) in zip(rows, brute_components(rows)) if i is None or i == c)
    kept = neardup.first_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.text for r in kept.collect()) == want
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_the_pipeline(spark, docs):
    """Two changed words in 120 leave 106 of 126 shingles, 84 %; three leave 77 %."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(30):
        family = [f"f{i}w{j}" for j in range(120)]
        rows.append((1000 + 2 * i, " ".join(family)))
        for j in range(2 + i % 2):
            family[20 + 30 * j] = "x"
        rows.append((1001 + 2 * i, " ".join(family)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(t for (i, t), (_, _, c) in zip(rows, brute_components(rows, percent=80)) if i is None or i == c)
    got = Counter(r.text for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == want
    assert [got[text] for _, text in rows[-60:]] == [1, 0, 1, 1] * 15


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()))
    assert got == {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, **{100 + i: 100 for i in range(31)}}


# sentence spans -----------------------------------------------------------------------------------------------------

def brute_spans(text, least=sentences.SPAN_WORDS, lone=sentences.LONE_WORDS):
    """All shortest spans by trying every pair."""
    parts = sentences.sentences(text)
    full = [i for i, p in enumerate(parts) if p.strip()]
    n = [len(parts[i].split()) for i in full]
    ok = lambda a, b: b > a and sum(n[a:b + 1]) >= least
    found = {(i, i) for i in range(len(full)) if n[i] >= lone}
    for a in range(len(full)):
        found |= {(a, b) for b in range(len(full)) if ok(a, b) and not ok(a, b - 1)}
        found |= {(b, a) for b in range(len(full)) if ok(b, a) and not ok(b + 1, a)}
    return parts, {(full[a], full[b]): " ".join(parts[i].strip() for i in full[a:b + 1]) for a, b in found}


def test_spans(texts):
    for text in texts:
        parts, want = brute_spans(text) if text else ([], {})
        assert "".join(parts) == (text or "") and sentences.spans(parts).keys() == want.keys()


def test_sentence_dedup(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rank = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, text in rows:
        for s in brute_spans(text)[1].values() if text else ():
            first[s] = min(first.get(s, 1 << 62), rank(i))
    want = Counter()
    for i, text in rows:
        parts, found = brute_spans(text) if text else ([], {})
        gone, seen = set(), set()
        for (a, b), s in sorted(found.items()):
            if first[s] < rank(i) or s in seen:
                gone.update(range(a, b + 1))
            seen.add(s)
        want[i, None if text is None else "".join(p for j, p in enumerate(parts) if j not in gone), len(gone)] += 1
    got = sentences.dedup(docs)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == want
    assert sum(n for (_, _, n), _ in want.items()) > 10
    kept = sentences.rewrite(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert Counter(r.text for r in kept.collect()) == Counter(
        t for (i, t, n), c in want.items() for _ in range(c) if not n or t.strip())
    assert sentences.dedup(no_docs).count() == 0


@pytest.mark.parametrize("n_words", [20, 29, 39])
def test_one_repeated_sentence(spark, n_words):
    """A sentence of 20 to 39 words between neighbours that differ."""
    one = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + "."
    shared = one("s", n_words)
    rows = [(i, f"{one(f'a{i}x', 15)} {shared} {one(f'b{i}x', 15)}") for i in range(3)]
    got = {r.doc_id: r for r in sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i, text in rows[1:]:
        assert got[i].n_removed == 1 and got[i].text == text.replace(shared + " ", "")


# substrings ---------------------------------------------------------------------------------------------------------

def test_suffix_array_of_all_small_texts():
    for n in range(8):
        for t in itertools.product(range(3), repeat=n):
            assert suffixes.suffix_array(list(t)) == sorted(range(n), key=lambda i: t[i:])


def test_suffix_array_of_long_texts():
    rng = random.Random(1)
    for text in ([rng.randrange(4) for _ in range(2000)], [0] * 500, [i % 7 for i in range(1500)], list(range(300, 0, -1))):
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_cut(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[a:a + length] for _, d in data for a in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - length + 1):
            if count[d[a:a + length]] > 1:
                gone[a:a + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0) == 1)
        out.append((i, len(d), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_anchors": 0}, {"most_contexts": 2}, {"most_contexts": 1}])
def test_substrings(docs, options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substrings.dedup(docs, **options).drop("kept").collect()
    assert Counter(map(tuple, got)) == brute_cut(rows, 200)


def test_bytes_decide_where_hashes_are_equal():
    data = np.frombuffer(b"abcdabceabcdx", np.uint8)
    starts, beside = np.array([0, 4, 8, 1, 0]), np.array([1, 1, 1, 1, 2])
    for hashes in ([5, 5, 5, 5, 5], [7, 1, 7, 2, 7], [7, 7, 7, 2, 3], [7, 1, 7, 2, 3]):
        met = substrings._met_again(data, starts, np.array(hashes, np.uint64), beside, 4)
        assert met.tolist() == [True, False, True, False, False]


def test_contexts_that_are_copies_are_sent_once(spark):
    rng = random.Random(8)
    shared = "".join(rng.choices("abcdef ", k=900))
    rows = [(i, shared + str(i % 2) * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substrings.dedup(df, most_contexts=3).drop("kept").collect())) == brute_cut(rows, 200)


def test_substrings_of_edited_copies(spark, no_docs):
    rng = random.Random(4)
    base = "".join(rng.choices("abcé ", k=1500))
    rows = []
    for i in range(30):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((i, "".join(text[rng.randrange(300):][:rng.randrange(150, 1400)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substrings.dedup(df).drop("kept").collect())) == brute_cut(rows, 200)
    assert substrings.dedup(no_docs).count() == 0


# chunks -------------------------------------------------------------------------------------------------------------

def test_boundaries_follow_content():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    ends = chunks.boundaries(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunks.LONGEST and sizes[:-1].min() >= chunks.SHORTEST
    moved = {e - 7 for e in chunks.boundaries(b"shifted" + data)}
    assert len(moved & set(ends)) > 0.9 * len(ends)
    slow = [sum((int(chunks._GEAR[data[i - j]]) << j) for j in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(100)]
    assert chunks.gear_hashes(np.frombuffer(data[:100], np.uint8)).tolist() == slow
    assert chunks.boundaries(b"") == []


def test_next_documents(docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        k = len(text) // 3
        new = text[:len(text) - k] + following[:k]
        own, changed, other = (chunks.fingerprint(t) for t in (text, new, following))
        want[i, len(text), hashlib.sha256(new.encode()).hexdigest(), chunks.as_string(own), chunks.as_string(changed),
             chunks.containment(own, changed), chunks.containment(own, other)] += 1
    assert Counter(map(tuple, chunks.compare_with_next(docs).collect())) == want
    assert chunks.compare_with_next(no_docs).count() == 0
    one = docs.where("doc_id IS NOT NULL").orderBy("doc_id").limit(1)
    assert chunks.compare_with_next(one).first().near_next == 1.0


# scores -------------------------------------------------------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    model = lm.Attention.start(rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)).astype(float))
    seen, ahead = rng.integers(0, lm.CLASSES, (2, 3, lm.WINDOW))
    valid = rng.random((3, lm.WINDOW)) < 0.8
    _, g = model.gradients(seen, ahead, valid)
    for name in lm.Attention.NAMES:
        for at in list(zip(*np.nonzero(np.abs(g[name]) > 1e-4)))[:4]:
            kept = model.p[name][at]
            up, down = [], []
            for sign, out in ((1, up), (-1, down)):
                model.p[name][at] = kept + sign * 1e-5
                out.append(model.gradients(seen, ahead, valid)[0])
            model.p[name][at] = kept
            assert abs((up[0] - down[0]) / 2e-5 - g[name][at]) < 1e-4


def test_windows_score_each_class_once():
    rng = np.random.default_rng(1)
    model = lm.Attention.start(rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)).astype(float))
    lengths = [1, 2, 23, 24, 25, 40, 41, 200]
    classes = rng.integers(0, lm.CLASSES, sum(lengths))
    ends = np.cumsum(lengths)
    got = model.tables().texts(classes, ends - lengths, ends)
    p, stride = model.p, lm.WINDOW - lm.OVERLAP
    for end, n in zip(ends, lengths):
        text = classes[end - n:end]
        before = np.append(lm.END, text[:-1])
        for i in range(n):
            start = 0 if i < lm.WINDOW else stride * ((i - lm.OVERLAP) // stride)
            context = np.arange(start, i + 1)
            w = np.exp(p["query"][before[i]] @ p["key"][before[context]].T + p["bias"][i - context])
            z = p["own"][before[i]] + (w / w.sum()) @ p["value"][before[context]] @ p["out"]
            assert abs(got[end - n + i] - (z[text[i]] - np.log(np.exp(z).sum())) / math.log(10)) < 1e-4


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 20, 0])
def test_scores(docs, no_docs, frequent):
    train = docs.where("doc_id % 7 <> 2 OR doc_id IS NULL")
    model, rare = lm.train(train, lm.read_vocabulary(), frequent)
    out = lm.score(docs, model, rare).collect()
    c = Counter()
    for r in train.collect():
        c.update(hashing.spaced_words(r.text))
        c[None] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in docs.collect():
        tokens = [*hashing.spaced_words(r.text), None]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)
        want[r.doc_id, len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert lm.score(no_docs, model, rare).count() == 0
    empty, none = lm.train(no_docs, lm.read_vocabulary())
    assert {r.n_known for r in lm.score(docs, empty, none).collect()} == {0}


def test_model_learns_from_all_texts(spark):
    """One text far above 20,000 characters and 2,500 short ones: pairs, weights and share know both."""
    rng = random.Random(2)
    rows = [(0, " ".join(rng.choice(["alpha beta", "gamma delta"]) for _ in range(6000)))]
    rows += [(i, f"epsilon zeta {i % 7}") for i in range(1, 2501)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, _ = lm.train(df, lm.read_vocabulary())
    coder, want = lm.Subwords(model.vocabulary), np.zeros((lm.CLASSES, lm.CLASSES))
    for _, text in rows:
        classes = [lm.END, *(model.classes[i] for w in hashing.spaced_words(text) for i in coder.ids(w)), lm.END]
        np.add.at(want, (classes[:-1], classes[1:]), 1)
    assert (lm.count_pairs(lm.tokenise(df, model.vocabulary), model) == want).all()
    first = lm.Attention.start(want).p
    assert all(np.abs(model.attention.p[x] - first[x]).max() > 0.01 for x in lm.Attention.NAMES)
    a, b, c = (model.classes[coder.ids(w)[0]] for w in (b"alpha", b"gamma", b"epsilon"))
    scores = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(
        [(1, "alpha beta " * 12), (2, "beta alpha " * 12)], df.schema), *lm.train(df.where("doc_id = 0"), model.vocabulary)).collect()}
    assert len({a, b, c}) == 3 and scores[1] > scores[2] + 1


def test_every_window_is_learned():
    rng = np.random.default_rng(4)
    lengths, copies = np.array([1, 24, 25, 700]), np.array([1, 3, 1, 2])
    classes, ends = rng.integers(0, lm.CLASSES, lengths.sum()), np.cumsum(lengths)
    learner = lm.Learner(lm.Attention.start(np.ones((lm.CLASSES, lm.CLASSES))))
    taken, learn = Counter(), learner.learn

    def noted(seen, ahead, weight, left):
        for kind, n in zip(ahead.ravel().tolist(), weight.ravel().tolist()):
            taken[kind] += n
        return learn(seen, ahead, weight, left)
    learner.learn = noted
    assert (learner.texts(classes, ends - lengths, ends, copies, lm.STEPS) < 0).all() and learner.windows == 1 + 3 + 2 + 60
    assert learner.step == lm.STEPS
    want = Counter(np.repeat(classes, np.repeat(copies, lengths)).tolist())
    assert {k: n for k, n in taken.items() if n} == {k: n * lm.STEPS for k, n in want.items()}


def test_many_windows_are_learned_once():
    classes = np.random.default_rng(4).integers(0, lm.CLASSES, lm.WINDOW * lm.BATCH * (lm.STEPS + 2))
    learner = lm.Learner(lm.Attention.start(np.ones((lm.CLASSES, lm.CLASSES))))
    learner.learn = lambda *batch: setattr(learner, "step", learner.step + 1) or np.full(batch[0].shape, -1.0)
    assert (learner.texts(classes, np.array([0]), np.array([len(classes)]), np.array([1])) == -1).all()
    assert learner.step == lm.STEPS + 2


def test_subwords_of_many_words():
    coder = lm.Subwords(lm.read_vocabulary())
    words = [b"the", "\u00e9t\u00e9".encode(), b"\xff\xe3\x81", b"x" * 100, "\u3000".encode(), b"ab" * 40, "\ud800".encode("utf-8", "surrogatepass")]
    size, ids = coder.all_ids(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [coder.ids(w) for w in words]
    assert len(coder.all_ids([])[0]) == 0


def test_company(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, "c b"), (3, None), (4, "")], "doc_id long, text string")
    coder = lm.Subwords(lm.read_vocabulary())
    tokens = lm.tokenise(df, lm.read_vocabulary())
    counts = lm.count_subwords(tokens, coder.size)
    a, b, c = (coder.ids(w)[0] for w in (b"a", b"b", b"c"))
    assert (counts[a], counts[b], counts[c], counts.sum()) == (2, 2, 2, 6)
    place = np.argsort(-counts, kind="stable").tolist().index
    got = lm.count_company(tokens, counts)
    assert {(i, k): got[i, k] for i, k in zip(*map(np.ndarray.tolist, np.nonzero(got)))} == {
        (a, lm.SINGLE): 1, (b, place(a)): 1, (c, place(b)): 1, (a, place(c)): 1, (c, lm.SINGLE): 1, (b, place(c)): 1}


def _likely(model, text):
    """log10 probability of a text word by word, from the definition of the model."""
    coder, p, c = lm.Subwords(model.vocabulary), model.attention.p, dict(zip(model.words.tolist(), model.counts.tolist()))
    words = hashing.spaced_words(text)
    ids = [coder.ids(w) for w in words]
    classes = [*(int(model.classes[i]) for w in ids for i in w), lm.END]
    before, stride, log_p = [lm.END, *classes[:-1]], lm.WINDOW - lm.OVERLAP, []
    for i, kind in enumerate(classes):
        start = 0 if i < lm.WINDOW else stride * ((i - lm.OVERLAP) // stride)
        at = np.array(before[start:i + 1])
        w = np.exp(p["query"][before[i]] @ p["key"][at].T + p["bias"][i - np.arange(start, i + 1)])
        z = p["own"][before[i]] + (w / w.sum()) @ p["value"][at] @ p["out"]
        log_p.append((z[kind] - np.log(np.exp(z).sum())) / math.log(10))
    total, at, every = 0.0, 0, model.tokens + model.distinct + 1
    for w, own in [*zip(words, ids), (None, [None])]:
        expert = sum(log_p[at:at + len(own)]) + sum(model.inside[i] for i in own if i is not None)
        at += len(own)
        n = model.ends if w is None else c.get(lm.xxh3_64_intdigest(w), 0)
        total += math.log10(model.share * (n + 1) / every + (1 - model.share) * 10 ** expert)
    return total


def test_score_against_its_definition_and_splits(docs, spark):
    """The same scores however the rows are split and ordered, equal to the mixture computed word by word."""
    got = []
    for parts in (1, 6):
        model, rare = lm.train(docs.repartition(parts, "source", "doc_id"), lm.read_vocabulary())
        got.append(sorted(((r.doc_id is None, r.doc_id, r.score) for r in lm.score(docs.repartition(parts), model, rare).collect()),
                          key=str))
    assert len(got[0]) == len(got[1]) and all(
        x[1] == y[1] and abs(x[2] - y[2]) < 1e-6 * max(1, abs(x[2])) for x, y in zip(*got))
    want = sorted(_likely(model, r.text) for r in docs.collect())
    assert np.allclose(want, sorted(x[2] for x in got[1]), rtol=1e-4, atol=1e-3)


def _ids(rng, size=300):
    """Ids with random classes, counts and weights."""
    of, counts = rng.integers(0, lm.END, size), rng.integers(0, 50, size)
    ids = lm.Ids(of, counts)
    return ids.with_weights(rng.normal(0, 0.3, ids.own.shape), ids.turn + rng.normal(0, 0.3, ids.turn.shape)), of, counts


def _within(ids, h, i):
    """log probability of an id within its class, turn by turn."""
    steps = range(ids.first[i], ids.first[i] + ids.depth[i])
    return sum(-math.log1p(math.exp(-ids.side[j] * (ids.turn[ids.path[j], :-1] @ h + ids.turn[ids.path[j], -1]))) for j in steps)


def test_ids_of_a_class_share_it():
    rng = np.random.default_rng(8)
    ids, of, counts = _ids(rng)
    h = rng.normal(0, 1, (1, lm.WIDTH))
    found = np.array([ids.turns(h, np.array([i]))[0] for i in range(len(of))])
    assert np.allclose(found, [_within(ids, h[0], i) for i in range(len(of))], atol=1e-5)
    assert np.allclose(np.bincount(of, np.exp(found)), 1) and ids.depth[ids.end] == 0
    start = lm.Ids(of, counts)
    inside = (counts + 0.5) / np.bincount(of, counts + 0.5)[of]
    assert np.allclose(np.exp(start.turns(np.repeat(h, len(of), axis=0), np.arange(len(of)))), inside)
    alone = lm.Ids(np.arange(lm.END), np.ones(lm.END, np.int64))
    assert (alone.turns(np.repeat(h, 3, axis=0), np.array([0, 5, alone.end]), np.ones(3))[0] == 0).all() and not len(alone.turn)


def test_gradients_of_ids():
    rng = np.random.default_rng(0)
    ids, _, _ = _ids(rng)
    model = lm.Attention(lm.Attention.start(rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)).astype(float)).p, ids)
    seen, ahead = rng.integers(0, ids.end + 1, (2, 3, lm.WINDOW))
    valid = rng.random((3, lm.WINDOW)) < 0.8
    _, g = model.gradients(seen, ahead, valid)
    every = {name: (model.p[name], g[name]) for name in lm.Attention.NAMES}
    for name in lm.Ids.NAMES:
        met, n, d = g[f"id {name}"]
        assert len(set(met.tolist())) == len(met) == len(n) == len(d)
        every[f"id {name}"] = getattr(ids, name), np.zeros_like(getattr(ids, name))
        every[f"id {name}"][1][met] = d
    assert g["id own"][1].sum() == seen.size and g["id turn"][1].sum() == ids.depth[ahead].sum()
    for p, d in every.values():
        for at in [*zip(*np.nonzero(np.abs(d) > 1e-4))][:12] + [*zip(*np.nonzero(d == 0))][:2]:
            kept, loss = p[at], []
            for sign in (1, -1):
                p[at] = kept + sign * 1e-5
                loss.append(model.gradients(seen, ahead, valid)[0])
            p[at] = kept
            assert abs((loss[0] - loss[1]) / 2e-5 - d[at]) < 1e-4


def _of_ids(attention, text):
    """log10 probability of every id of a text, its end included, from the definition of the model."""
    p, ids, stride, out = attention.p, attention.ids, lm.WINDOW - lm.OVERLAP, []
    before = [ids.end, *text[:-1]]
    q, k, v = (p[x][ids.of[before]] + ids.own[before][:, i * lm.WIDTH:(i + 1) * lm.WIDTH] for i, x in enumerate(("query", "key", "value")))
    for i, wanted in enumerate(text):
        at = np.arange(0 if i < lm.WINDOW else stride * ((i - lm.OVERLAP) // stride), i + 1)
        w = np.exp(k[at] @ q[i] + p["bias"][i - at])
        h = w / w.sum() @ v[at]
        z = p["own"][ids.of[before[i]]] + h @ p["out"]
        out.append((z[ids.of[wanted]] - np.log(np.exp(z).sum()) + _within(ids, h, wanted)) / math.log(10))
    return out


def test_windows_score_each_id_once():
    rng = np.random.default_rng(1)
    ids, _, _ = _ids(rng)
    model = lm.Attention(lm.Attention.start(rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)).astype(float)).p, ids)
    lengths = [1, 2, 23, 24, 25, 40, 41, 200]
    text, ends = rng.integers(0, ids.end, sum(lengths)), np.cumsum(lengths)
    text[ends - 1] = ids.end
    want = [x for end, n in zip(ends, lengths) for x in _of_ids(model, text[end - n:end].tolist())]
    assert np.allclose(model.tables().texts(text, ends - lengths, ends), want, atol=1e-4)


def test_rows_out_of_range():
    """Logits beyond what exp can hold give the same probabilities."""
    x = np.random.default_rng(0).normal(0, 1, (4, 9)).astype(np.float32)
    want = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    for far in (0, 500, -500):
        some, total = lm._exp_rows(x + np.float32(far), x[:, 2] + np.float32(far))
        assert np.allclose(some - np.log(total), want[:, 2], atol=1e-4)


def _likely_by_id(model, text):
    """log10 probability of a text word by word, where ids have weights of their own."""
    coder, c = lm.Subwords(model.vocabulary), dict(zip(model.words.tolist(), model.counts.tolist()))
    words = hashing.spaced_words(text)
    found = [coder.ids(w) for w in words]
    log_p, at, total, every = _of_ids(model.attention, [i for w in found for i in w] + [coder.size]), 0, 0.0, model.tokens + model.distinct + 1
    for w, size in [*zip(words, map(len, found)), (None, 1)]:
        n = model.ends if w is None else c.get(lm.xxh3_64_intdigest(w), 0)
        total += math.log10(model.share * (n + 1) / every + (1 - model.share) * 10 ** sum(log_p[at:at + size]))
        at += size
    return total


def test_score_by_id_against_its_definition_and_splits(docs):
    got = []
    for parts in (1, 6):
        model, rare = lm.train(docs.repartition(parts, "source", "doc_id"), lm.read_vocabulary(), by_id=True)
        got.append(sorted(((r.doc_id is None, r.doc_id, r.score) for r in lm.score(docs.repartition(parts), model, rare).collect()),
                          key=str))
    assert len(got[0]) == len(got[1]) and all(
        x[1] == y[1] and abs(x[2] - y[2]) < 1e-6 * max(1, abs(x[2])) for x, y in zip(*got))
    want = sorted(_likely_by_id(model, r.text) for r in docs.collect())
    assert np.allclose(want, sorted(x[2] for x in got[1]), rtol=1e-4, atol=1e-3)


def test_scores_tell_ids_by_context(spark, tmp_path):
    """Every left word has its own right word; texts with the same words in other pairs are less likely by far."""
    from tripmart.llm.queries import QUERIES

    coder, rng = lm.Subwords(lm.read_vocabulary()), random.Random(4)
    words = [w for w in (a + b + c for a in "bdklmnprst" for b in "aeiou" for c in "dlmnrst") if len(coder.ids(w.encode())) == 1]
    left, right = words[:60], words[60:120]
    assert len(right) == 60
    pairs = lambda shift: [f"{left[i]} {right[(i + shift) % 60]}" for i in rng.sample(range(60), 60)]
    rows = [(i, " ".join(pairs(0))) for i in range(300)]
    held = [i for i in range(300, 600) if zlib.crc32(str(i).encode()) % 7 == 2][:20]
    rows += [(i, " ".join(pairs(k % 2 * 7))) for k, i in enumerate(held)]
    spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in QUERIES["op10_lm"](spark, str(tmp_path)).collect()}
    assert min(scores[i] for i in held[::2]) > max(scores[i] for i in held[1::2]) + 150


def test_blocks_of_texts():
    batch = lambda *rows: pa.record_batch([pa.array(x) for x in zip(*rows)], names=["classes", "edges", "copies"])
    rows = [(b"aa", b"x", 1), (b"aa", b"x", 2), (b"aa", b"y", 1), (b"bbbb", b"", 1), (b"bbbb", b"", 4), (b"c", b"", 1)]
    want = [[[b"aa", b"x", 3], [b"aa", b"y", 1]], [[b"bbbb", b"", 5]], [[b"c", b"", 1]]]
    for cut in range(1, len(rows)):
        assert list(lm._blocks([batch(*rows[:cut]), batch(*rows[cut:])], 3)) == want
    assert len(list(lm._blocks([batch(*rows)], math.inf))) == 1 and list(lm._blocks([], 3)) == []


def test_weights_of_ids_are_averaged(spark):
    ids, _, _ = _ids(np.random.default_rng(5))
    rows, want = [], {name: getattr(ids, name).copy() for name in lm.Ids.NAMES}
    rng = np.random.default_rng(6)
    for i, name in enumerate(lm.Ids.NAMES):
        n, sums = np.zeros(len(want[name])), np.zeros_like(want[name])
        for shard in range(3):
            at, met = np.sort(rng.choice(len(n), 5, replace=False)), rng.integers(1, 9, 5)
            own = rng.normal(0, 1, (5, sums.shape[1])).astype(np.float32)
            n[at] += met
            sums[at] += met[:, None] * own
            rows.append((i, shard, at.astype(np.int64).tobytes(), met.astype(np.int64).tobytes(), own.tobytes()))
        want[name][n > 0] = sums[n > 0] / n[n > 0, None]
    df = spark.createDataFrame([(None, None, *r) for r in rows], lm._SHARDS).repartition(2)
    got = lm._averaged(df, ids)
    assert all(np.allclose(getattr(got, x), want[x], atol=1e-6) for x in lm.Ids.NAMES)


# archives -----------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "x"), (2, "http://b/ü", "<p>é</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "u", "<p>é</p>"),
         (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (None, "v", "alone"), (9, "w", "long " * 200_000)]


@pytest.mark.parametrize("least", [0, 3])
def test_archives(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(pages, folder, least_bytes=least, archive_bytes=400)
    rows = warc.read_archives(manifest, folder, payloads=True).collect()
    want = Counter()
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [i for i, _, h in PAGES if (h or "").encode() == data]
        keeper = max((i for i in same if i is not None), default=None)
        repeat = len(data) >= least and len(same) > 1 and keeper is not None and page_id != keeper
        want[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
             "revisit" if repeat else "response", keeper if repeat else None, None if repeat else data] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in rows) == want
    assert all(r.problem is None for r in rows)
    # one gzip member a record
    for path in {r.path for r in rows}:
        assert gzip.open(path).read().count(b"WARC/1.1\r\n") == sum(r.path == path for r in rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_archives():
    good = b"".join(warc._member(warc.record(i, "u", b"payload %d" % i, None, "2000-01-01T00:00:00Z")) for i in range(3))
    assert [r["problem"] for r in warc.read_records(io.BytesIO(good), True)] == [None] * 3
    torn = list(warc.read_records(io.BytesIO(good[:-20])))
    assert [r["problem"] is None for r in torn] == [True, True, False]
    text = warc.record(1, "u", b"payload", None, "2000-01-01T00:00:00Z").replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    (bad,) = warc.read_records(io.BytesIO(warc._member(text)))
    assert bad["problem"] == "payload digest"


def test_reading_goes_on_behind_damaged_records():
    """Of five members the second has a wrong length, is torn, or is no record: the others come back."""
    whole = [warc.record(i, "http://a/", b"x" * 3000 + bytes([65 + i]) * 50, None, "2000-01-01T00:00:00Z") for i in range(5)]
    members = [warc._member(r) for r in whole]
    noise = bytes((i * 37 + 11) % 256 for i in range(400))
    for damaged in (warc._member(whole[1].replace(b"Content-Length: 3", b"Content-Length: 2")), warc._member(b"nothing\r\n\r\n"),
                    members[1][:30] + b"\xff\x00\x1f\x8b\x08" * 9 + members[1][60:], members[1][:len(members[1]) // 2], noise,
                    warc._MAGIC + noise):
        found = list(warc.read_records(io.BytesIO(b"".join([members[0], damaged, *members[2:]])), True))
        good = [r["page_id"] for r in found if r["problem"] is None]
        assert good == [0, 2, 3, 4] and 1 <= len(found) - len(good) <= 2, damaged[:40]
        assert all(r["payload"] is not None for r in found if r["problem"] is None)


def test_a_payload_of_very_many_pages(spark):
    rows = [(i if i % 3 else None, f"u{i}", "same") for i in range(60)] + [(7, "u7", "same"), (99, "z", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    back = warc.round_trip(pages).collect()
    assert len(back) == len(rows) and {r.problem for r in back} == {None}
    assert Counter((r.record_type, r.refers_to) for r in back) == {("response", None): 2, ("revisit", 59): 60}
