"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, html, jaccard, manifest, pieces, quality, quality_rules, resampling, sharding, token_counts, toxicity
from .common import crc32_mod, fresh_path, table

BYTE_BPE, PIECE_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc32_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return verdicts(toxicity.score_texts(docs.select("doc_id", "text"), model), held_out)


def verdicts(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.shard_groups(table(spark, sf_dir, "documents"), shards=8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = fresh_path(spark, "token-cache")
    token_counts.count_tokens(table(spark, sf_dir, "benchmark"), BYTE_BPE, cache, id_col="item_id")  # the cache that documents then meet
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def piece_digests(docs: DataFrame) -> DataFrame:
    coded = pieces.encode_decode(docs.select("doc_id", "text"), PIECE_BPE)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc32_mod("doc_id", 3) == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return verdicts(quality.score_texts(docs.select("doc_id", "text"), model), held_out)


def op9_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    leaves = manifest.build(table(spark, sf_dir, "documents"), fields, group=F.col("lang"), id_col="doc_id", changed=(crc32_mod("doc_id", 7) == 0, tampered))
    proved = leaves.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(manifest.siblings(), 256).alias("proof_sha256"), manifest.fold(F.coalesce("changed", "leaf")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bin_packing, op3_token_counts, op4_hnsw, op5_sentencepiece, op6_quote_links, op7_jaccard_join, op8_quality, op9_host_paths, op10_decontamination, op11_resampling, op12_quality_rules, op13_merkle_manifest, pipeline)}
SQL: dict[str, str] = {
    "op6_quote_links": r"""
WITH RECURSIVE told AS (SELECT row_number() OVER () AS m, * FROM (SELECT DISTINCT conv_id, turn, role, text AS raw FROM conversations)),
split AS (SELECT m, conv_id, turn, unnest(string_split(coalesce(raw, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(raw, ''), chr(10)), 1) AS pos FROM told),
lines AS (SELECT m, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:[ \t]*>)*)', '') AS line FROM split),
attributed AS (SELECT m, conv_id, turn, pos, line, CASE WHEN level = 0 AND lead(level) OVER (PARTITION BY m ORDER BY pos) > 0 AND regexp_matches(line, '^[ \t]*((on|am|le|el) .*)?(wrote|writes|schrieb|a écrit|escribió)[^a-z]*:[ \t\r]*$', 'i') THEN -1 ELSE level END AS level FROM lines),
marked AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY m ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM attributed),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY pos) AS passage FROM marked),
own AS (SELECT m, conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS told FROM runs WHERE level = 0 GROUP BY ALL),
passages AS (SELECT m, conv_id, turn, passage, level, string_agg(line, ' ' ORDER BY pos) AS told FROM runs GROUP BY m, conv_id, turn, passage, level),
source AS (SELECT conv_id, turn, told FROM own UNION ALL SELECT conv_id, turn, told FROM passages WHERE level = 0 UNION ALL SELECT conv_id, turn, line FROM runs WHERE level = 0),
first AS (SELECT conv_id, h, min(turn) AS source_turn FROM (SELECT conv_id, turn, trim(regexp_replace(translate(told, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g')) AS h FROM source) WHERE h <> '' GROUP BY ALL),
units AS (SELECT m, conv_id, turn, passage, level, 0 AS part, told FROM passages WHERE level > 0 UNION ALL SELECT m, conv_id, turn, passage, level, 1, line FROM runs WHERE level > 0),
hashed AS (SELECT * EXCLUDE told, trim(regexp_replace(translate(told, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g')) AS h FROM units),
links AS (SELECT m, passage, level, part, max(source_turn) AS source_turn FROM hashed JOIN first USING (conv_id, h) WHERE h <> '' AND source_turn < turn GROUP BY ALL),
best AS (SELECT m, passage, level, arg_min(source_turn, part) AS source_turn FROM links GROUP BY ALL),
linked AS (SELECT m, arg_min(source_turn, level) AS parent_turn, sum(n) AS n_linked FROM (SELECT m, level, max(source_turn) AS source_turn, count(*) AS n FROM best GROUP BY ALL) GROUP BY m),
answers AS (SELECT t.conv_id, t.turn, min(l.parent_turn) AS parent FROM linked l JOIN told t USING (m) GROUP BY ALL),
chains AS (SELECT conv_id, turn, parent AS root FROM answers UNION ALL SELECT c.conv_id, c.turn, a.parent FROM chains c JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.root),
roots AS (SELECT conv_id, turn, min(root) AS root FROM chains GROUP BY ALL),
quoted AS (SELECT m, count(*) AS n_quoted, max(level) AS max_level FROM passages WHERE level > 0 GROUP BY m)
SELECT t.conv_id, t.turn, t.role, coalesce(trim(o.told), '') AS text, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::INT AS max_level, parent_turn,
  (row_number() OVER (PARTITION BY t.conv_id ORDER BY coalesce(r.root, t.turn), t.turn, t.role, md5(coalesce(trim(o.told), ''))) - 1)::BIGINT AS reply_pos
FROM told t LEFT JOIN own o ON o.m = t.m LEFT JOIN quoted q ON q.m = t.m LEFT JOIN linked l ON l.m = t.m LEFT JOIN roots r ON r.conv_id = t.conv_id AND r.turn = t.turn
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM s JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, g
""",
    "op10_decontamination": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n)),
m AS (SELECT r, s, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""",
    "op11_resampling": r"""
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tbl),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, 0 AS side FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, 1 FROM benchmark),
told AS (SELECT r, side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
features AS (SELECT r, side, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT r, side, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM told, (VALUES (1), (2), (3)) AS v(k))),
bucketed AS (SELECT f, (xor(list_reduce(range(length(hex(encode(f))) // 2), lambda c, i: xor(c >> 8, tbl[(xor(c, ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) & 255) + 1]), 4294967295), 4294967295) % 10000)::BIGINT AS b
  FROM (SELECT DISTINCT f FROM features), tbl),
placed AS (SELECT r, side, b FROM features JOIN bucketed USING (f)),
counts AS (SELECT i AS b, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY b) c ON c.b = i),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (b) WHERE side = 0 GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM told LEFT JOIN weighed USING (r) WHERE side = 0),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS n, (5 * count(*) OVER ()) // 100 AS wanted FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= wanted THEN n END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r)
""",
    "op12_quality_rules": r"""
WITH told AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM told)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM starts) GROUP BY r),
counts AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM told LEFT JOIN again USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
measures AS (SELECT r, lang, source, base_failed, unnest(['word_length', 'symbol_share', 'line_share', 'repeat_share']) AS measure,
    unnest([coalesce(100 * word_chars // nullif(n_words, 0), 0), coalesce(1000 * n_symbols // nullif(word_chars, 0), 0), coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0), coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)]) AS v FROM judged),
bins AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)) AS b, count(*) AS n FROM measures WHERE NOT base_failed GROUP BY ALL),
sketches AS (SELECT 0 AS level, lang, source, measure, b, n FROM bins UNION ALL SELECT 1, lang, NULL, measure, b, sum(n) FROM bins GROUP BY lang, measure, b UNION ALL SELECT 2, NULL, NULL, measure, b, sum(n) FROM bins GROUP BY measure, b),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS n_rows FROM sketches),
quartiles AS (SELECT level, lang, source, measure, max(n_rows) AS n_rows, min(b) FILTER (upto * 4 >= n_rows) AS q1, min(b) FILTER (upto * 4 >= n_rows * 3) AS q3 FROM ranked GROUP BY ALL),
picked AS (SELECT s.lang, s.source, s.measure, CASE WHEN s.n_rows >= 100 THEN s.q1 WHEN l.n_rows >= 100 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN s.n_rows >= 100 THEN s.q3 WHEN l.n_rows >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM quartiles s JOIN quartiles l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM s.lang AND l.measure = s.measure JOIN quartiles a ON a.level = 2 AND a.measure = s.measure WHERE s.level = 0),
fences AS (SELECT lang, source, measure, CASE WHEN measure = 'word_length' THEN q1 - 3 * greatest(q3 - q1, 40) ELSE 0 END AS low,
    q3 + 3 * greatest(q3 - q1, CASE measure WHEN 'word_length' THEN 40 WHEN 'symbol_share' THEN 20 WHEN 'line_share' THEN 100 ELSE 50 END) AS high FROM picked),
outside AS (SELECT DISTINCT r FROM measures m JOIN fences f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source AND f.measure = m.measure WHERE v < low OR v > high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.r IS NULL AS kept FROM judged j LEFT JOIN outside o ON o.r = j.r
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tbl),
told AS (SELECT row_number() OVER () AS r, d.*, (xor(list_reduce(range(length(doc_id::VARCHAR)), lambda c, i: xor(c >> 8, tbl[(xor(c, ascii(substr(doc_id::VARCHAR, i + 1, 1))) & 255) + 1]), 4294967295), 4294967295) % 7 = 0)
    AND n_chars IS NOT NULL AS tampered FROM documents d, tbl),
digests AS (SELECT r, doc_id, lang, sha256(concat(f1, f2, f3, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), f5)) AS leaf, CASE WHEN tampered THEN sha256(concat(f1, f2, f3, strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), f5)) END AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f1, coalesce(strlen(source) || ':' || source, '-') AS f2, coalesce(strlen(lang) || ':' || lang, '-') AS f3, coalesce(strlen(text) || ':' || text, '-') AS f5 FROM told)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM digests),
tree AS (SELECT 0 AS level, lang, pos, leaf AS h, n FROM leaves UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY level, lang, pos // 2, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS h, n FROM subroots UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
path AS (SELECT r, 0 AS level, lang, pos, n, '' AS proof, coalesce(changed, leaf) AS cur FROM leaves
  UNION ALL SELECT p.r, p.level + 1, p.lang, p.pos // 2, (p.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN p.pos % 2 = 0 THEN cur || coalesce(s.h, '') ELSE s.h || cur END)
  FROM path p LEFT JOIN tree s ON s.level = p.level AND s.lang IS NOT DISTINCT FROM p.lang AND s.pos = xor(p.pos, 1) WHERE p.n > 1),
onward AS (SELECT r, 0 AS level, s.pos, s.n, proof, cur FROM path p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL SELECT p.r, p.level + 1, p.pos // 2, (p.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN p.pos % 2 = 0 THEN cur || coalesce(s.h, '') ELSE s.h || cur END)
  FROM onward p LEFT JOIN top s ON s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.n > 1)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN onward o ON o.r = l.r AND o.n = 1 JOIN top t ON t.n = 1
""",
}
