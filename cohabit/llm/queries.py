"""The contract queries ``opN_<name>`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, jaccard, merkle, neardup, secrets, sentencepiece, sharding, urlfilter, warc
from .common import table
from .decontaminate import contaminated, mark
from .quality import fit, held_out, score

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

#: At or above this score a document counts as good.
GOOD = 0.3
QUALITY_METADATA = ("n_chars",)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()), metadata=QUALITY_METADATA)
    return score(docs, model, metadata=QUALITY_METADATA).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the pages' own URLs: some rules are added, some of those removed and added again."""
    rules = pages.select(F.explode(urlfilter.rules_of(F.col("url"))).alias("rule")).distinct()
    dice = F.conv(F.substring(F.md5("rule"), 1, 7), 16, 10).cast("long")
    dated = rules.where(dice % 4 == 0).select("rule", dice.alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), dice % 3)).alias("k"))
    return dated.select("rule", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("d") % 200 + F.col("k") * 60).cast("int")).alias("listed_on"), F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int")))
    judged = urlfilter.judge(captures, list_entries(pages))
    return judged.select("page_id", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), F.size("blocked_by").cast("long").alias("n_rules"), F.array_join("blocked_by", ",").alias("rules"), (F.size("blocked_by") > 0).alias("blocked"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1), '/') AS seg,
                  DATE '2024-01-01' + CAST(((page_id * 7919) % 365 + 365) % 365 AS INTEGER) AS day FROM pages),
s AS (SELECT page_id, url, day, seg, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda k: array_to_string((string_split(host, '.'))[k:], '.'))) AS suffix FROM p WHERE host <> ''),
x AS (SELECT page_id, url, day, suffix, unnest(list_concat([''], list_transform(list_filter(range(1, len(seg) + 1), lambda k: seg[k] <> ''), lambda k: array_to_string(seg[1:k], '/')))) AS prefix FROM s),
c AS (SELECT DISTINCT page_id, url, day, suffix || prefix AS rule FROM x),
r AS (SELECT rule, CAST('0x' || substr(md5(rule), 1, 7) AS BIGINT) AS d FROM (SELECT DISTINCT rule FROM c)),
e AS (SELECT rule, DATE '2024-01-01' + CAST(d % 200 + k * 60 AS INTEGER) AS f, k FROM (SELECT rule, d, unnest(range(0, d % 3 + 1)) AS k FROM r WHERE d % 4 = 0)),
hit AS (SELECT c.page_id, c.url, c.day, c.rule FROM c JOIN e ON c.rule = e.rule WHERE e.k % 2 = 0 AND e.f <= c.day
        AND NOT EXISTS (SELECT 1 FROM e x WHERE x.rule = e.rule AND x.f > e.f AND x.f <= c.day)),
g AS (SELECT page_id, url, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, count(DISTINCT rule) AS n FROM hit GROUP BY page_id, url)
SELECT p.page_id, strftime(p.day, '%Y-%m-%d') AS fetched_on, CAST(coalesce(n, 0) AS BIGINT) AS n_rules, coalesce(rules, '') AS rules, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN g ON p.page_id = g.page_id AND p.url = g.url
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece.load()
    coded = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, decoded="decoded", best="n_viterbi")
    return coded.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "n_viterbi", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


SHARDS = 24


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, turns, len(turns) AS n, list_transform(turns, lambda x: {'role': x.role, 'text': x.text}) AS body FROM t),
x AS (SELECT DISTINCT body[1:i] AS body FROM (SELECT body, unnest(range(1, n)) AS i FROM k)),
m AS (SELECT body, min(conv_id) AS conv_id, count(*) AS n_copies FROM k GROUP BY body)
SELECT m.conv_id, CAST(k.n AS BIGINT) AS n_turns, m.n_copies,
       array_to_string(list_transform(k.turns, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM m JOIN k ON k.conv_id = m.conv_id WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.body = m.body)
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.links(table(spark, sf_dir, "embeddings"), 0.9)


OP9_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e
      WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0
      WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (WITH RECURSIVE w(x, y) AS (SELECT x, y FROM l UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x) SELECT x, min(y) AS m FROM w GROUP BY x),
c AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM e LEFT JOIN c ON c.x = vec_id LEFT JOIN r ON r.x = vec_id
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


OP10_SQL = r"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, coalesce(html, '') AS h, row_number() OVER () AS rid FROM pages),
q AS (SELECT *, sha256(h) AS payload_digest, CAST(strlen(h) AS BIGINT) AS payload_bytes,
             array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://(?:www\.)?([^/?#]*)', 1), '.')), ',') || ')' || regexp_extract(u, '^[a-z]+://[^/?#]*([^#]*)', 1) AS url_key,
             strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds((coalesce(page_id, 0) * 7919) % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM p),
g AS (SELECT payload_digest, min(page_id) AS origin FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN origin IS NULL OR origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin IS NULL OR origin = page_id THEN NULL ELSE origin END AS refers_to, url_key, captured_at,
       row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST, rid) - 1 AS position
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest
"""

def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = lambda n: [F.col(c) for c in ("doc_id", "source", "lang")] + [n, F.col("text")]
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(chosen, merkle.leaf(*values(F.col("n_chars").cast("long") + 1)))
    rows = docs.select("doc_id", "lang", merkle.leaf(*values(F.col("n_chars"))).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(rows, "lang", "doc_id").withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PARENTS = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"
_CRC_BITS = "list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {_CRC_BITS}), 4294967295)"
_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
OP11_SQL = f"""
WITH RECURSIVE x AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF("(n_chars + 1)")} END AS tampered FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid FROM x),
lv AS (SELECT lang, 0 AS l, list(leaf ORDER BY pos) AS h FROM d GROUP BY lang UNION ALL SELECT lang, l + 1, {_PARENTS} FROM lv WHERE len(h) > 1),
sr AS (SELECT lang, l AS depth, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lpos FROM lv WHERE len(h) = 1),
up AS (SELECT 0 AS l, list(subroot ORDER BY lpos) AS h FROM sr UNION ALL SELECT l + 1, {_PARENTS} FROM up WHERE len(h) > 1),
root AS (SELECT l AS depth, h[1] AS root FROM up WHERE len(h) = 1),
sib AS (SELECT rid, lv.l, pos >> lv.l AS place, lv.h[xor(pos >> lv.l, 1) + 1] AS s FROM d JOIN sr ON d.lang IS NOT DISTINCT FROM sr.lang JOIN lv ON lv.lang IS NOT DISTINCT FROM d.lang AND lv.l < sr.depth
        UNION ALL SELECT rid, sr.depth + up.l, lpos >> up.l, up.h[xor(lpos >> up.l, 1) + 1] FROM d JOIN sr ON d.lang IS NOT DISTINCT FROM sr.lang CROSS JOIN root JOIN up ON up.l < root.depth),
p AS (SELECT rid, list({{'place': place, 's': coalesce(s, '')}} ORDER BY l) AS steps FROM sib GROUP BY rid),
f AS (SELECT d.rid, 1 AS k, coalesce(tampered, leaf) AS v, steps FROM d LEFT JOIN p USING (rid)
      UNION ALL SELECT rid, k + 1, CASE WHEN steps[k].place % 2 = 0 THEN sha256(v || steps[k].s) ELSE sha256(steps[k].s || v) END, steps FROM f WHERE k <= coalesce(len(steps), 0))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda t: t.s), ''), '')) AS proof_sha256, v AS folded_root, v = root AS verified
FROM d JOIN sr ON d.lang IS NOT DISTINCT FROM sr.lang CROSS JOIN root JOIN f ON f.rid = d.rid AND f.k = coalesce(len(steps), 0) + 1
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode(docs, bpe.load(), decoded_to="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.load(), sentencepiece.load(), derive={"groups_sha256": groups})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_urlfilter": op3_urlfilter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_jaccard": op5_jaccard,
    "op6_sharding": op6_sharding,
    "op7_chat": op7_chat,
    "op8_secrets": op8_secrets,
    "op9_embeddings": op9_embeddings,
    "op10_warc": op10_warc,
    "op11_merkle": op11_merkle,
    "op12_bpe": op12_bpe,
    "op13_align": op13_align,
}
ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_urlfilter": OP3_SQL, "op7_chat": OP7_SQL, "op9_embeddings": OP9_SQL, "op10_warc": OP10_SQL, "op11_merkle": OP11_SQL}
