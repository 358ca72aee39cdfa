"""The registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import arrow_tokens, bpe, embedding_dedup, exact_dedup, html_main, minhash_dedup, mixing, sharding, toxicity, url_filter
from quire.llm.common import table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"), keep="max")


def op3_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"), width=2).drop("th")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def shard_sql(limit: int) -> str:
    return f"""
WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
deep AS (SELECT r.*, d::INTEGER AS depth, CASE WHEN d = 0 THEN 0 ELSE h >> (60 - d) END AS prefix FROM r, range(0, 61) t(d)),
node AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS bytes, min(h) = max(h) AS alone FROM deep GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, h, depth, prefix, bytes, alone, row_number() OVER (PARTITION BY depth, prefix, h ORDER BY doc_id) - 1 AS nth
         FROM (SELECT deep.*, bytes, alone, min(depth) OVER (PARTITION BY h) AS first FROM deep JOIN node USING (depth, prefix) WHERE bytes <= {limit} OR alone) WHERE depth = first),
paged AS (SELECT *, CASE WHEN alone AND bytes > {limit} THEN greatest(1, {limit} // n_bytes) END AS room FROM leaf)
SELECT doc_id, n_bytes, depth, prefix::BIGINT AS prefix, coalesce(nth // room, 0)::BIGINT AS page,
       (CASE WHEN room IS NULL THEN bytes ELSE least(room, bytes // n_bytes - (nth // room) * room) * n_bytes END)::BIGINT AS shard_bytes
FROM paged"""


MIX_SQL = f"""
WITH m AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before, sum(weight) OVER () AS weight_all FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (weight_all - weight_before) AS level FROM f),
water AS (SELECT arg_min(level, weight_before) AS water FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, least(cap, coalesce(water * weight, cap)) AS target FROM l LEFT JOIN water ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT m.*, source_size, target, whole, coalesce(sum(size) OVER (PARTITION BY m.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cum,
      sum(size) OVER (PARTITION BY m.source, h) AS alike FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN cum - alike + alike / 2.0 <= target - whole * source_size AND target > whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
URL_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT row_number() OVER () AS row, page_id, translate(raw, {_AZ}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY c.row ORDER BY length(r.host || r.path) DESC NULLS LAST, r.host || r.path DESC) AS nth
      FROM c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM d WHERE nth = 1"""


DEDUP_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g ON t.text = g.text"""


#: All pairs of a label, and the smallest vec_id that each row reaches.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)"""


#: Equal sets are one class; classes that share a shingle rare enough to be a prefix are compared on their whole sets.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
      ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS sh FROM w),
c AS (SELECT md5(array_to_string(sh, chr(10))) AS c, any_value(sh) AS sh, min(doc_id) AS first, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT c, n, unnest(sh) AS t FROM c),
f AS (SELECT t, count(*) AS df FROM x GROUP BY t),
o AS (SELECT c, n, t, row_number() OVER (PARTITION BY c ORDER BY df, t) AS nth FROM x JOIN f USING (t)),
pre AS (SELECT c, n, t FROM o WHERE nth <= n - ceil(n * 0.8) + 1),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b FROM pre a JOIN pre b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
mutual AS (SELECT a, b, len(list_intersect(ca.sh, cb.sh)) AS i, ca.n + cb.n AS total FROM cand JOIN c ca ON ca.c = a JOIN c cb ON cb.c = b),
link AS (SELECT a, b FROM mutual WHERE 100 * i >= 80 * (total - i)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c, c AS other FROM c UNION SELECT r.c, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT r.c, min(o.first) AS component_id FROM reach r JOIN c o ON o.c = r.other GROUP BY r.c)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM s LEFT JOIN comp ON len(s.sh) > 0 AND comp.c = md5(array_to_string(s.sh, chr(10)))"""


def oracle_sql() -> dict[str, str]:
    return {"op7_minmax_near_dedup": MINHASH_SQL, "op6_cross_polytope_dedup": EMBEDDING_SQL, "op2_lsm_exact_dedup": DEDUP_SQL, "op1_extendible_shards": shard_sql(sharding.LIMIT_BYTES), "op5_capped_mix": MIX_SQL, "op10_url_filter": URL_SQL}
