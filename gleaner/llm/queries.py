"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, embeddings, licences, lmscore, minhash, neighbours, quality, repeats, runs, tokencount, warc


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer()))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), F.broadcast(licences.known_licences(spark)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), share=(85, 100))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ties UNION SELECT r.a, e.b FROM reach r JOIN ties e ON r.b = e.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id))::BIGINT AS component_id, doc_id <= coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = doc_id
"""


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


OP4_SQL = r"""
WITH RECURSIVE x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM x WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_dot_product(p.e, q.e) >= 0.95 * p.n * q.n),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id))::BIGINT AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    wanted = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lmscore.score(docs, wanted)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS wanted, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, wanted, u.a AS a, u.b AS b, u.first AS first, u.last AS last FROM (SELECT doc_id, wanted, unnest(list_transform(range(1, len(w) + 1), lambda i: {'a': CASE WHEN i > 1 THEN w[i-1] ELSE '' END, 'b': w[i], 'first': i = 1, 'last': i = len(w)})) AS u FROM d)),
n AS (SELECT count(*) FILTER (WHERE wanted) AS t, count(*) AS c, count(DISTINCT b) AS v, count(*) FILTER (WHERE wanted AND first) AS st, count(*) FILTER (WHERE first) AS sc FROM p),
k AS (SELECT s, t + 0.5 * greatest(262144, v) AS ft, c * s + 0.5 * greatest(262144, v) AS fc, ln(st + 20.0::DOUBLE) AS bt, ln(sc * s + 20.0::DOUBLE) AS bc FROM (SELECT *, CASE WHEN t > 0 AND c > 0 THEN t::DOUBLE / c ELSE 1.0::DOUBLE END AS s FROM n)),
single AS (SELECT b, count(*) FILTER (WHERE wanted) AS wt, count(*) AS wc FROM p GROUP BY 1),
pairs AS (SELECT a, b, count(*) FILTER (WHERE wanted) AS pt, count(*) AS pc FROM p GROUP BY 1, 2),
losses AS (SELECT a, b, round((ln(wt + 20.0::DOUBLE) - ln(pt + 20.0::DOUBLE * (wt + 0.5::DOUBLE) / ft)) * 16777216)::BIGINT AS lt, round((ln(wc * s + 20.0::DOUBLE) - ln(pc * s + 20.0::DOUBLE * (wc * s + 0.5::DOUBLE) / fc)) * 16777216)::BIGINT AS lc,
    round(ln(wt + 20.0::DOUBLE) * 16777216)::BIGINT AS et, round(ln(wc * s + 20.0::DOUBLE) * 16777216)::BIGINT AS ec FROM pairs JOIN single USING (b), k),
sums AS (SELECT doc_id, count(*) AS n, sum(lt - CASE WHEN last THEN et ELSE 0 END) AS zt, sum(lc - CASE WHEN last THEN ec ELSE 0 END) AS zc FROM p JOIN losses USING (a, b) GROUP BY 1),
means AS (SELECT doc_id, n, (zt::DOUBLE / 16777216 + bt) / n AS mt, (zc::DOUBLE / 16777216 + bc) / n AS mc FROM sums, k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(round(mt, 6), 0.0)::DOUBLE AS target_loss, coalesce(round(mc, 6), 0.0)::DOUBLE AS background_loss, coalesce(round(mt - mc, 6), 0.0)::DOUBLE AS score
FROM documents LEFT JOIN means USING (doc_id)
"""


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(warc.captures(_table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return done.select("record_id", "url", "response_id", "outcome", F.coalesce(F.array_join(entries, "\n"), F.lit("")).alias("headers"))


OP6_SQL = r"""
WITH bare AS (SELECT page_id, substr(md5(coalesce(html, '')), 1, 16) AS tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS u FROM pages),
parts AS (SELECT page_id, tag, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$'))) AS q FROM bare),
p AS (SELECT page_id, tag, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM parts),
asked AS (SELECT page_id * 2 + 1 AS record_id, url, (page_id + 500) * 2 + 1 AS t, tag FROM p),
full_ones AS (SELECT page_id * 2 AS response_id, url, page_id * 2 AS t, tag FROM p),
found AS (SELECT a.record_id, a.url, a.t, a.tag, f.response_id, f.tag AS tag_then FROM asked a ASOF LEFT JOIN full_ones f ON a.url = f.url AND a.t >= f.t)
SELECT record_id, url, CASE WHEN tag = tag_then THEN response_id END AS response_id,
    CASE WHEN response_id IS NULL THEN 'no earlier response' WHEN tag = tag_then THEN 'resolved' ELSE 'validator differs' END AS outcome,
    CASE WHEN tag = tag_then THEN 'Content-Type: text/html' || chr(10) || 'ETag: "' || tag || '"' || chr(10) || 'date: ' || t ELSE '' END AS headers
FROM found
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.dedup(_table(spark, sf_dir, "documents"), spacing=False)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS h FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM later, range(20) AS r(k)),
kept AS (SELECT doc_id, u.i AS i, u.word AS word FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {'i': i, 'word': w[i]})) AS u FROM d)),
left_over AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM kept k ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.i = g.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
hits AS (SELECT doc_id, item_id, n, count(*) AS f FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY 1, 2, 3 HAVING count(*) * 5 >= n * 4),
best AS (SELECT doc_id, count(*) AS n_items, first(item_id ORDER BY round(f / n, 6) DESC, item_id) AS best_item, max(round(f / n, 6)) AS containment FROM hits GROUP BY 1)
SELECT doc_id, coalesce(n_items, 0)::BIGINT AS n_items, best_item, coalesce(containment, 0.0)::DOUBLE AS containment, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN best USING (doc_id)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = alignment.align(_table(spark, sf_dir, "documents"), _tokenizer(), _tokenizer("piece_bpe_32k.model"), digest=True)
    return done.withColumnRenamed("groups", "groups_sha256")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runs.periodic_runs(runs.with_periodic_tails(_table(spark, sf_dir, "documents")))
    line = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(r["starts"], F.lit(","), r["lengths"], F.lit(","), r["periods"], F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select("doc_id", F.size("starts").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), digest(F.array_join(line, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumn("score", F.round("score", 12))  # sums in another order differ after that


OP13_SQL = r"""
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM x WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, max(round(list_dot_product(q.e, v.e) / (q.n * v.n), 12)) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e) GROUP BY 1, 2),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licences": op2_licences,
    "op3_minhash": op3_minhash,
    "op4_embeddings": op4_embeddings,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_revisits": op6_revisits,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_runs": op12_runs,
    "op13_neighbours": op13_neighbours,
}

SQL: dict[str, str] = {"op2_licences": licences.scan_sql(), "op4_embeddings": OP4_SQL, "op5_lm_scoring": OP5_SQL, "op6_revisits": OP6_SQL, "op3_minhash": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op8_decontamination": OP8_SQL, "op13_neighbours": OP13_SQL}
