"""The operators over the given tables, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import (
    chunks,
    decontaminate,
    langid,
    licenses,
    lm,
    merkle,
    mixing,
    neardup,
    negatives,
    sentences,
    substrings,
    urls,
    warc,
)

from tripmart.llm.text import lower_ascii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The word classes in RE2 form, as words of a text in SQL.
_ALNUM = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_SPACED = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM.format('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS t
  FROM i, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS u(s) WHERE len(w) > 0),
spans AS (
  SELECT DISTINCT d.r, s, n, t FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(0, len(w) - n + 1)) AS u(s),
    LATERAL (SELECT array_to_string(w[s + 1 : s + n], ' ') AS t) AS x WHERE t IN (SELECT t FROM win)),
hit AS (SELECT r, count(DISTINCT s + j) AS n_hit FROM spans, unnest(range(0, n)) AS u(j) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM spans JOIN win USING (t)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(f"""
WITH d AS (SELECT doc_id, source, CAST(len({_SPACED.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS DOUBLE) / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv,
    row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY cap * (10 // weight), i)),
t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE),
    (SELECT arg_min(lv, k) FROM l WHERE CAST(cap AS DOUBLE) >= lv * weight) * weight), 0.0) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS share,
    CAST(('0x' || substr(md5('17:' || coalesce(d.source, chr(1))), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * CAST(least(floor(place * share + u) - floor((place - 1) * share + u), 3) AS BIGINT) AS taken FROM p""")
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.base}, string_split('{t.text}', ' '))" for i, t in enumerate(licenses.TEMPLATES))


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format('text')} AS w FROM documents),
t(id, label, base, words) AS (VALUES {_TEMPLATES}),
g AS (
  SELECT id, label, base, len(words) AS n, k, q, array_to_string(words[q + 1 : q + k], ' ') AS gram
  FROM t, LATERAL (SELECT least(len(words), 3) AS k) AS a, unnest(range(0, len(words) - k + 1)) AS u(q)),
x AS (SELECT r, k, p, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM d, (VALUES (2), (3)) AS a(k), unnest(range(0, len(w) - k + 1)) AS u(p)),
v AS (SELECT DISTINCT r, id, label, base, n, k, q, p - q AS diagonal FROM x JOIN g USING (k, gram)),
b AS (SELECT r, label, diagonal AS first_word, 1.0::DOUBLE AS coverage FROM v WHERE base GROUP BY r, id, label, diagonal, n, k HAVING count(*) = n - k + 1),
m AS (
  SELECT DISTINCT r, id, diagonal,
    coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) > 3, true) AS new
  FROM (SELECT DISTINCT r, id, diagonal FROM v WHERE NOT base)),
c AS (SELECT r, id, diagonal, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r, id ORDER BY diagonal) AS cluster FROM m),
l AS (
  SELECT r, label, count(DISTINCT q + j) / any_value(n) AS coverage
  FROM v JOIN c USING (r, id, diagonal), unnest(range(0, k)) AS u(j) GROUP BY r, id, label, cluster
  HAVING count(DISTINCT q + j) / any_value(n) >= 0.8),
f AS (
  SELECT r, count(first_word) AS n_base, min(first_word) AS first_word, max(first_word) AS last_word,
    string_agg(DISTINCT CASE WHEN first_word IS NOT NULL THEN label END, ',' ORDER BY CASE WHEN first_word IS NOT NULL THEN label END) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM (SELECT r, label, first_word, coverage FROM b UNION ALL SELECT r, label, NULL, coverage FROM l) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN f USING (r)""")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SPACED.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s + 1 : s + least(len(w), 5)], ' ')) AS h
  FROM d, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS u(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh AS a JOIN sh AS b ON a.h = b.h AND a.doc_id < b.doc_id
    JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
step AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, s.y FROM reach AS r JOIN step AS s ON r.y = s.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)""")
def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentences.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


@query()
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = langid.train(docs.where("NOT held_out"), langid.read_pieces())
    return langid.predict(docs, model, ("doc_id", "held_out"))


@query("""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h HAVING count(*) > 1)
SELECT page_id, payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, j)
   FROM (SELECT g, CAST('0x' || substr(h, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT) AS v FROM unnest(range(8)) AS a(g)), unnest(range(4)) AS b(j)) AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN k USING (h)""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


@query()
def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compare_with_next(table(spark, sf_dir, "documents"))


@query()
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string")) % 7 == 2, F.lit(False))
    tokens = lm.tokenise(docs, lm.read_vocabulary(), ~held_out(F.col("doc_id")))
    model, rare = lm.train(tokens, lm.read_vocabulary(), by_id=True)
    return lm.score(tokens, model, rare).withColumn("held_out", held_out(F.col("doc_id")))


@query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS s
  FROM d, unnest(range(0, CAST(len(h) // 2 - 199 AS BIGINT))) AS u(i)),
g AS (SELECT r, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
m AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM g),
n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM m),
s AS (SELECT r, k, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY r, k),
e AS (SELECT r, lo, hi, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS nxt, row_number() OVER (PARTITION BY r ORDER BY lo) AS k FROM s),
c AS (
  SELECT d.r, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed,
    string_agg(CASE WHEN k = 1 THEN substr(h, 1, CAST(2 * lo AS BIGINT)) ELSE '' END ||
      substr(h, CAST(2 * hi + 1 AS BIGINT), CAST(2 * (coalesce(nxt, len(h) // 2) - hi) AS BIGINT)), '' ORDER BY lo) AS kept
  FROM e JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (r)""")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("kept")


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


@query(f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format(text='text')} AS leaf,
    {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered FROM documents),
crc(b, c, k) AS (
  SELECT b, b::UBIGINT, 0 FROM range(256) AS t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
code(r, id, pos, c) AS (
  SELECT r, CAST(doc_id AS VARCHAR), 1, 4294967295::UBIGINT FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, id, pos + 1, xor(code.c >> 8, crc.c) FROM code
    JOIN crc ON k = 8 AND crc.b = xor(code.c, ascii(id[pos])::UBIGINT) & 255 WHERE pos <= len(id)),
flag AS (SELECT r, xor(c, 4294967295::UBIGINT) % 3 = 0 AS tampered FROM code WHERE pos = len(id) + 1),
place AS (
  SELECT d.*, CASE WHEN tampered THEN lowered ELSE leaf END AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM d LEFT JOIN flag USING (r)),
node(lang, level, i, h, m) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM place
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 7) // 8
  FROM node WHERE m > 1 GROUP BY lang, level, i // 8),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS li FROM node WHERE m = 1),
top(level, i, h, m) AS (
  SELECT 0, li, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 7) // 8
  FROM top WHERE m > 1 GROUP BY level, i // 8),
step AS (
  SELECT a.lang, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS g
  FROM node AS a JOIN node AS b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.i // 8 = b.i // 8
  WHERE a.m > 1 GROUP BY ALL),
up AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS g
  FROM top AS a JOIN top AS b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.m > 1 GROUP BY ALL),
way AS (
  SELECT r, level AS k, l, g FROM place JOIN step
    ON place.lang IS NOT DISTINCT FROM step.lang AND step.i = CAST(floor(place.i / pow(8, level)) AS BIGINT)
  UNION ALL
  SELECT r, 100 + level, l, g FROM place JOIN sub ON place.lang IS NOT DISTINCT FROM sub.lang
    JOIN up ON up.i = CAST(floor(li / pow(8, level)) AS BIGINT)),
path AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS n FROM way),
folded(r, n, h) AS (
  SELECT r, 0, shown FROM place
  UNION ALL SELECT f.r, f.n + 1, sha256(l || h || g) FROM folded AS f JOIN path AS p ON p.r = f.r AND p.n = f.n + 1),
last AS (SELECT r, arg_max(h, n) AS folded_root FROM folded GROUP BY r),
proof AS (SELECT r, string_agg(l || g, '' ORDER BY n) AS p FROM path GROUP BY r)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM place JOIN sub ON place.lang IS NOT DISTINCT FROM sub.lang JOIN top ON top.m = 1 JOIN last USING (r) LEFT JOIN proof USING (r)""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    shown = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in fields]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").isNotNull(),
                      merkle.digest(*[merkle.field(c) for c in shown]))
    rows = merkle.manifest(docs, "lang", "doc_id", fields, [F.col("doc_id"), tampered.alias("tampered")])
    folded = rows.withColumn("folded_root", merkle.fold(F.coalesce("item.tampered", "leaf"), F.col("path")))
    return folded.select("item.doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", F.col("vec_id") % 100 == 0)


def _like(glob: str) -> str:
    return "".join({"*": "%", "?": "_", "%": "$%", "_": "$_", "$": "$$", "'": "''"}.get(c, c) for c in glob)


_GLOBS = ", ".join(f"({i}, '{r.verdict}', '{r.name}', {r.listed}, {len(r.name) if r.listed else r.literals}, '{_like(r.host)}', '{_like(r.path)}')"
                   for i, r in enumerate(urls.RULES))


@query(f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
g(i, verdict, name, listed, size, hosts, paths) AS (VALUES {_GLOBS}),
w AS (
  SELECT r, arg_min(g, (NOT listed, -size, i)) AS best FROM p JOIN g ON '.' || host LIKE hosts ESCAPE '$' AND path LIKE paths ESCAPE '$' GROUP BY r)
SELECT page_id, host, path, CASE WHEN best.listed THEN best.name END AS rule, best.name AS glob,
  coalesce(best.verdict, '{urls.DEFAULT}') AS verdict FROM p LEFT JOIN w USING (r)""")
def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
