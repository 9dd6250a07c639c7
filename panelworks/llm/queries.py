"""One query per operator, over its whole table, and the SQL that states the same result where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, exactdedup, fim, mixing, quality, sharding, simhash, substring, tokencount, trie, urlfilter, warc
from .. import ship
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The contract's rules, and the filter's own patterns for hosts that exist to sell or to farm links.
URL_RULES = [urlfilter.Rule("block", "net/"), urlfilter.Rule("allow", "example.net/en/"), urlfilter.Rule("block", "example.com/de/"), urlfilter.Rule("allow", "org/fr/")]
URL_PATTERNS = [urlfilter.Rule("block", "||cheap-pills.", True), urlfilter.Rule("block", "||spam-farm.", True)]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES + URL_PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


OP1_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS site FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(site, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(coalesce(site, ''), length(regexp_extract(coalesce(site, ''), '^[^/]*')) + 1) AS path FROM r),
t AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s),
p AS (SELECT *, CASE WHEN rule IS NULL AND ('.' || host || path) LIKE '%.cheap-pills.%' AND contains('.' || host, '.cheap-pills.') THEN '||cheap-pills.'
  WHEN rule IS NULL AND contains('.' || host, '.spam-farm.') THEN '||spam-farm.' END AS pattern FROM t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM p
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(_table(spark, sf_dir, "documents"), size=20)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, s, sha256(array_to_string(list_slice(ws, s, s + 19), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
f AS (SELECT h, min({'d': doc_id, 's': s}) AS lead FROM v GROUP BY h HAVING count(*) > 1),
r AS (SELECT v.doc_id, list(v.s) AS starts FROM v JOIN f ON v.h = f.h WHERE {'d': v.doc_id, 's': v.s} > f.lead GROUP BY v.doc_id),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM r)) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS m, CASE WHEN gone IS NULL THEN ws ELSE
  (SELECT coalesce(list(ws[i] ORDER BY i), []) FROM (SELECT unnest(range(1, len(ws) + 1)) AS i) WHERE NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(_table(spark, sf_dir, "pages"), path, compression="none")  # so that archives are divided where they are large
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return warc.read_warc(spark, path).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.first IS NULL OR d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns, lengths = trie.rebuilt(trie.turn_rows(_table(spark, sf_dir, "conversations")), base=conv - conv % 100, head=F.crc32(conv.cast("string")) % 6)
    return trie.prefix_trie(turns, lengths)


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, sha256(CAST(length(r) AS VARCHAR) || ':' || r || x) AS k, length(x) AS z, turn FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT c, k, z, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM t),
-- CRC-32 of the decimal id: a byte is mixed in (value of 0 and more), then eight steps of one bit (-1).
h AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS own, o.p, o.k, o.z FROM h JOIN o ON o.c = h.b AND o.p <= h.h UNION ALL SELECT h.c, 1, o.p, o.k, o.z FROM h JOIN o ON o.c = h.c AND o.p > h.h),
q AS (SELECT c, k, z, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM r),
s AS (SELECT h.c, coalesce(list(q.k ORDER BY q.d) FILTER (q.d IS NOT NULL), []) AS ks, coalesce(list(q.z ORDER BY q.d) FILTER (q.d IS NOT NULL), []) AS zs, count(q.d) AS n FROM h LEFT JOIN q ON q.c = h.c GROUP BY h.c),
m AS (SELECT c, n, d, sha256(array_to_string(ks[1:d], ' ')) AS pre, CASE WHEN d = 0 THEN 0 ELSE zs[d] END AS z FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM s)),
g AS (SELECT d, pre, min(c) AS top, count(*) AS n_convs, max(z) AS z, max(n) AS far, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM m GROUP BY d, pre),
up AS (SELECT m.c, m.d, g.top FROM m JOIN g ON m.d = g.d AND m.pre = g.pre),
kids AS (SELECT g.d - 1 AS d, up.top, count(*) AS n FROM g JOIN up ON up.c = g.top AND up.d = g.d - 1 GROUP BY 1, 2),
e AS (SELECT g.*, up.top AS parent, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN up ON up.c = g.top AND up.d = g.d - 1 LEFT JOIN kids ON kids.d = g.d AND kids.top = g.top),
below AS (SELECT up.d, up.top, sum(CASE WHEN e.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((e.n_convs - 1) * e.z) AS saved FROM e JOIN up ON up.c = e.top AND up.d <= e.d GROUP BY 1, 2)
SELECT e.top AS conv_id, CAST(e.d AS BIGINT) AS depth, e.parent AS parent_conv_id, e.n_convs, CAST(e.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN below b ON b.d = e.d AND b.top = e.top
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), grammar="line", seed=7, rate=100, spm_rate=50)
    restored = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid, coalesce(array_to_string(us[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


QUERIES = {"op1_url_filters": op1_url_filters, "op2_substring_dedup": op2_substring_dedup, "op10_decontamination": op10_decontamination, "op3_token_counts": op3_token_counts, "op7_quality": op7_quality, "op8_nearest": op8_nearest, "op9_warc": op9_warc, "op4_mix_sources": op4_mix_sources, "op5_simhash": op5_simhash, "op6_shards": op6_shards, "op11_prefix_trie": op11_prefix_trie, "op12_exact_dedup": op12_exact_dedup, "op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op1_url_filters": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op9_warc": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
