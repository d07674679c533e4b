"""The queries of the text operators and their SQL; ``__spark_entry__`` adds them.

No SQL: op1, op7, op9 and op10 learn models, op6 compares sketches first; the tests hold
them against brute force and held-out accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, codes, decontam, langid, lines, merkle, mixing, quality, rules, substring, suffixes, tiles, toxicity
from .shared import table


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.measure_mix(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tiled_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_resident_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.label_errors(done.rows).select("vec_id", codes.code_text().alias("code"), "error", "label_error", F.lit(codes.books_sha256(done.codebooks)).alias("codebooks_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit, merkle.leaf(docs, changed={"n_chars": F.try_add(docs["n_chars"], F.lit(1))}))
    made = merkle.build(docs, tampered=tampered)
    hexed = lambda c: F.lower(F.hex(c))
    proofs = merkle.prove(made).select(F.col("id").alias("doc_id"), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(made.root).alias("root"), hexed("tampered").alias("tampered"), "path")
    digests = proofs.select("doc_id", "leaf", "subroot", "root", merkle.siblings_sha256().alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_quality, op2_substring_dedup, op3_suffix_array_dedup, op4_source_mixing, op5_line_dedup, op6_bagminhash_dedup,
        op7_weak_quality, op8_decontamination, op9_language_id, op10_toxicity,
        op11_tiled_embedding_dedup, op12_resident_lloyd_codes, op13_merkle_manifest, pipeline,
    )
}



def lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after another; numbers by (vector, part, place)."""
    near = "SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.vec_id, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) AS d FROM x JOIN {b} b USING (p, i) GROUP BY 1, 2, 3) GROUP BY 1, 2"
    mean = "SELECT p, e, i, coalesce(s, b.x) AS x FROM {b} b LEFT JOIN (SELECT p, e, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS s FROM x JOIN {a} USING (vec_id, p) GROUP BY 1, 2, 3) USING (p, e, i)"
    steps = "".join(f", a{r} AS MATERIALIZED ({near.format(b=f'b{r}')}), b{r + 1} AS MATERIALIZED ({mean.format(b=f'b{r}', a=f'a{r}')})" for r in range(rounds))
    return f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (g - 1) // (n // {parts}) AS p, (g - 1) % (n // {parts}) AS i, CAST(floor(4096 * v[g]) AS BIGINT) AS x FROM (SELECT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS g FROM v)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT p, e, i, x FROM x JOIN seed USING (vec_id)){steps}, a AS MATERIALIZED ({near.format(b=f'b{rounds}')}),
c AS (SELECT vec_id, string_agg(lower(lpad(printf('%x', e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"""


def merkle_sql(levels: int = 24, top: int = 8) -> str:
    """All levels of every language's tree, of the tree of their roots, and each proof's fold."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda n: f"sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    up = lambda a, b: f", {b} AS MATERIALIZED (SELECT t, i // 2 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, any_value((m + 1) // 2) AS m FROM {a} GROUP BY 1, 2)"
    trees = "".join(up(f"l{k}", f"l{k + 1}") for k in range(levels))
    tops = "".join(up(f"r{k}", f"r{k + 1}") for k in range(top))
    fold, last = "", "f0"
    for k in range(levels + top):
        node, at, name = (f"l{k}", f"(i >> {k})", "t") if k < levels else (f"r{k - levels}", f"(j >> {k - levels})", "0")
        fold += f""", f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (p, z), p || coalesce(s.h, '') AS p,
CASE WHEN n.m = 1 THEN z WHEN s.h IS NULL THEN sha256(z) WHEN {at} % 2 = 1 THEN sha256(s.h || z) ELSE sha256(z || s.h) END AS z
FROM {last} f JOIN {node} n ON n.t IS NOT DISTINCT FROM {f'f.{name}' if name == 't' else '0'} AND n.i = {at.replace('(i', '(f.i').replace('(j', '(f.j')}
LEFT JOIN {node} s ON s.t IS NOT DISTINCT FROM {f'f.{name}' if name == 't' else '0'} AND s.i = xor({at.replace('(i', '(f.i').replace('(j', '(f.j')}, 1::BIGINT))""".replace(f"WHEN {at} %", f"WHEN {at.replace('(i', '(f.i').replace('(j', '(f.j')} %")
        last = f"f{k + 1}"
    bit = "c"
    for _ in range(8):
        bit = f"xor({bit} >> 1, 3988292384::BIGINT * ({bit} & 1))" if bit == "c" else f"list_transform([{bit}], lambda c: xor(c >> 1, 3988292384::BIGINT * (c & 1)))[1]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: list_transform([xor(a, b)], lambda c: {bit})[1]), 4294967295::BIGINT)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang AS t, {leaf('n_chars')} AS h, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS w,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM documents),
l0 AS (SELECT t, i, h, m FROM d){trees},
r0 AS MATERIALIZED (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, h, count(*) OVER () AS m, t AS lang FROM l{levels}){tops},
f0 AS (SELECT doc_id, d.t, d.i, d.h, '' AS p, coalesce(w, d.h) AS z, r0.i AS j, r0.h AS subroot FROM d JOIN r0 ON d.t IS NOT DISTINCT FROM r0.lang){fold}
SELECT doc_id, f.h AS leaf, subroot, g.h AS root, sha256(p) AS proof_sha256, z AS folded_root, z = g.h AS verified FROM {last} f, r{top} g"""


ORACLES = {
    "op11_tiled_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT a AS id, a AS reach FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(c, v.vec_id) AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT id AS vec_id, min(reach) AS c FROM r GROUP BY 1) USING (vec_id)""",
    "op12_resident_lloyd_codes": lloyd_sql(),
    "op13_merkle_manifest": merkle_sql(),
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
         FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_suffix_array_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k
        FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 49)) AS i FROM b)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
late AS (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE doc_id > m),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z
         FROM (SELECT *, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
               FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM late)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER o, 0) AS a, a AS z FROM runs WINDOW o AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT doc_id, coalesce(max(z), 0), NULL FROM b LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * gaps.a + 1 AS BIGINT), CAST(coalesce(2 * (gaps.z - gaps.a), length(h)) AS BIGINT)), '' ORDER BY gaps.a) AS t
         FROM gaps JOIN b USING (doc_id) GROUP BY 1),
spans AS (SELECT doc_id, sum(z - a) AS n, count(*) AS s FROM runs GROUP BY 1)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)""",
    "op4_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
weighed AS (SELECT *, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM per),
summed AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(source_size * 3) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
           FROM weighed WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST)),
level AS (SELECT *, CAST(total - filled AS DOUBLE) / open_weight AS lvl FROM summed),
filled AS (SELECT *, source_size * 3 <= lvl * weight AS is_full FROM level),
final AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(source_size * 3 AS DOUBLE) ELSE
            (SELECT arg_min(lvl, source_size / weight) FROM filled WHERE NOT is_full) * weight END AS target FROM filled),
rated AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
            CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0 AS u
          FROM d JOIN final ON d.source IS NOT DISTINCT FROM final.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM rated""",
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT doc_id, p, line, key IN (SELECT key FROM often) AS dropped FROM k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY 1""",
    "op8_decontamination": r"""
WITH raw AS (SELECT 0 AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 1, CAST(item_id AS VARCHAR), text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
pat AS (SELECT id AS item, n, array_to_string(ws[i:i + n - 1], ' ') AS k
        FROM (SELECT id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM w WHERE kind = 1 AND len(ws) > 0)),
win AS (SELECT id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
        FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM pat) WHERE kind = 0)),
hits AS (SELECT DISTINCT win.id, i, win.n, item FROM win JOIN pat ON win.k = pat.k AND win.n = pat.n),
covered AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM hits) GROUP BY 1)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered ON covered.id = w.id LEFT JOIN items ON items.id = w.id WHERE kind = 0""",
}
