"""The queries ``opN_<name>`` over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.divergence import source_divergence
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.filter_audit import document_failures, filter_audit
from quillgraph.llm.html_extract import extract_main_text
from quillgraph.llm.line_dedup import line_dedup
from quillgraph.llm.lm_scoring import lm_scores
from quillgraph.llm.mixing import mix
from quillgraph.llm.near_dedup import near_duplicates
from quillgraph.llm.quality import fit_quality, quality_scores
from quillgraph.llm.topk_search import build_index, search
from quillgraph.llm.toxicity import fit_toxicity, toxicity_scores
from quillgraph.llm.url_filter import RULES, SOFT_TERMS, STRICT_TERMS, judge_urls
from quillgraph.runtime import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs, labels = _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = docs.select("doc_id", "text")
    return quality_scores(texts, fit_quality(texts, labels)).select("doc_id", "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs, labels = _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, fit_toxicity(docs, labels))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component under 3-word shingles and a similarity of at least 0.85."""
    docs = _table(spark, sf_dir, "documents")
    return near_duplicates(docs, n=3, num=85, den=100)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its stupid-backoff score under trigrams of all other documents; the mean has four decimals, as far as sums in any order agree."""
    scored = lm_scores(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("mean_log_score", 4).alias("mean_log_score"))


def op4_lm_scoring_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under bigrams, with one step of backoff."""
    scored = lm_scores(_table(spark, sf_dir, "documents"), order=2)
    return scored.select("doc_id", "n_tokens", F.round("mean_log_score", 4).alias("mean_log_score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with the rule that fits and the verdict. The SQL knows no escapes and only ASCII letters; the tables hold no other URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, with the lines that differencing and the markup took."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, of those dropped, and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside windows of benchmark items."""
    docs, items = _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).drop("items")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters takes, for every source, order of the filters and step."""
    failures = document_failures(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    audit = filter_audit(failures, "ABCDE", ("good", "toxic"))
    return audit.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance to each other of its language, and the terms that set it apart from the language."""
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every vector whose id is divisible by 50, over all other vectors."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    questions = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return search(build_index(vectors), questions, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_url_filter": op5_url_filter,
    "op6_html_extraction": op6_html_extraction,
    "op7_mixing": op7_mixing,
    "op9_decontamination": op9_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_topk_search": op13_topk_search,
}

#: Further settings of an operator, registered beside its query.
MORE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_lm_scoring_bigrams": op4_lm_scoring_bigrams}

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _any_term(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)


_ALNUM_WORDS = "regexp_extract_all(" + _LOWER.format(x="coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_lm_scoring": f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, ws FROM d),
g AS (SELECT doc_id, p, ws[p] AS w, CASE WHEN p > 1 THEN ws[p - 1] END AS h, CASE WHEN p > 2 THEN ws[p - 2] END AS hh FROM t),
o1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL), c1 AS (SELECT w, sum(n) AS n FROM o1 GROUP BY ALL),
o2 AS (SELECT doc_id, h, w, count(*) AS n FROM g WHERE h IS NOT NULL GROUP BY ALL), c2 AS (SELECT h, w, sum(n) AS n FROM o2 GROUP BY ALL),
o3 AS (SELECT doc_id, hh, h, w, count(*) AS n FROM g WHERE hh IS NOT NULL GROUP BY ALL), c3 AS (SELECT hh, h, w, sum(n) AS n FROM o3 GROUP BY ALL),
r1 AS (SELECT doc_id, w, c1.n - o1.n AS n FROM o1 JOIN c1 USING (w)),
r2 AS (SELECT doc_id, h, w, c2.n - o2.n AS n FROM o2 JOIN c2 USING (h, w)),
r3 AS (SELECT doc_id, hh, h, w, c3.n - o3.n AS n FROM o3 JOIN c3 USING (hh, h, w)),
k AS (SELECT count(*) AS total FROM g),
s AS (
  SELECT g.doc_id, g.p, greatest(a.n, 1) / greatest(total - len(d.ws), 1) AS one, b.n AS two, bh.n AS two_h, c.n AS three, ch.n AS three_h
  FROM g CROSS JOIN k JOIN d ON d.doc_id = g.doc_id JOIN r1 a ON a.doc_id = g.doc_id AND a.w = g.w
  LEFT JOIN r2 b ON b.doc_id = g.doc_id AND b.h = g.h AND b.w = g.w LEFT JOIN r1 bh ON bh.doc_id = g.doc_id AND bh.w = g.h
  LEFT JOIN r3 c ON c.doc_id = g.doc_id AND c.hh = g.hh AND c.h = g.h AND c.w = g.w LEFT JOIN r2 ch ON ch.doc_id = g.doc_id AND ch.h = g.hh AND ch.w = g.h
), f AS (
  SELECT doc_id, CASE WHEN three > 0 AND three_h > 0 THEN three / three_h
    ELSE (CASE WHEN p > 2 THEN 0.4 ELSE 1 END) * CASE WHEN two > 0 AND two_h > 0 THEN two / two_h ELSE (CASE WHEN p > 1 THEN 0.4 ELSE 1 END) * one END END AS score FROM s
)
SELECT d.doc_id, len(d.ws) AS n_tokens, round(x.m, 4) AS mean_log_score
FROM d LEFT JOIN (SELECT doc_id, avg(ln(score)) AS m FROM f GROUP BY doc_id) x USING (doc_id)""",
    "op4_lm_scoring_bigrams": f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, ws FROM d),
g AS (SELECT doc_id, p, ws[p] AS w, CASE WHEN p > 1 THEN ws[p - 1] END AS h FROM t),
o1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL), c1 AS (SELECT w, sum(n) AS n FROM o1 GROUP BY ALL),
o2 AS (SELECT doc_id, h, w, count(*) AS n FROM g WHERE h IS NOT NULL GROUP BY ALL), c2 AS (SELECT h, w, sum(n) AS n FROM o2 GROUP BY ALL),
r1 AS (SELECT doc_id, w, c1.n - o1.n AS n FROM o1 JOIN c1 USING (w)),
r2 AS (SELECT doc_id, h, w, c2.n - o2.n AS n FROM o2 JOIN c2 USING (h, w)),
k AS (SELECT count(*) AS total FROM g),
s AS (
  SELECT g.doc_id, CASE
    WHEN g.h IS NULL THEN greatest(a.n, 1) / greatest(total - len(d.ws), 1)
    WHEN b.n > 0 AND hh.n > 0 THEN b.n / hh.n
    ELSE 0.4 * greatest(a.n, 1) / greatest(total - len(d.ws), 1) END AS score
  FROM g CROSS JOIN k JOIN d ON d.doc_id = g.doc_id JOIN r1 a ON a.doc_id = g.doc_id AND a.w = g.w
  LEFT JOIN r1 hh ON hh.doc_id = g.doc_id AND hh.w = g.h LEFT JOIN r2 b ON b.doc_id = g.doc_id AND b.h = g.h AND b.w = g.w
)
SELECT d.doc_id, len(d.ws) AS n_tokens, round(x.m, 4) AS mean_log_score
FROM d LEFT JOIN (SELECT doc_id, avg(ln(score)) AS m FROM s GROUP BY doc_id) x USING (doc_id)""",
    "op5_url_filter": f"""
WITH u AS (
  SELECT page_id, {_LOWER.format(x="coalesce(url, '')")} AS low, {_LOWER.format(x="coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}
), s AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(s.verdict, length(rule)) AS verdict
  FROM u JOIN s ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT u.page_id, host, path, rule,
  coalesce(verdict, CASE WHEN {_any_term(STRICT_TERMS)} > 0 OR {_any_term(SOFT_TERMS)} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id)""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_ALNUM_WORDS} AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM bw),
dw AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n),
h AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win FROM dw) x JOIN iw USING (n, win)),
q AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format(x="coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, {_LOWER.format(x="trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, coalesce(text, '') AS t, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS fails
  FROM d LEFT JOIN m USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM l a JOIN l b ON b.letter <> a.letter JOIN l c ON c.letter NOT IN (a.letter, b.letter)
  JOIN l d ON d.letter NOT IN (a.letter, b.letter, c.letter) JOIN l e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)
), s AS (
  SELECT filter_order, CAST(step AS INT) AS step, bit,
    CAST((SELECT coalesce(sum(b.bit), 0) FROM l b WHERE strpos(filter_order, b.letter) < step) AS INT) AS before FROM o CROSS JOIN range(1, 6) r(step) JOIN l ON l.letter = substr(filter_order, step, 1)
), x AS (
  SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x""",
    "op12_source_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (SELECT r, lang, source, unnest(ws) AS term FROM d
), v AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10
), c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL
), l AS (SELECT lang, count(*) AS V, sum(total) AS N FROM v GROUP BY lang
), g AS (SELECT d.lang, d.source, coalesce(any_value(x.N), 0) AS N FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS N FROM c GROUP BY ALL) x USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.N + 2 * l.V) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (l.N + 2 * l.V) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
