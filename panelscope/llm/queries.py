"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, exact_dedup, html_extract, licenses, merkle, mixing, near_dedup, packing, quality, substring_dedup, toxicity, url_filter, whitening
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


# -- 6: URL lists ----------------------------------------------------------
# The tables hold no fetch times and no lists: both are derived from the pages.
_HEX = "0123456789abcdef"


def _digit(text, at: int):
    """Value of the at-th hexadecimal digit of the md5 of text."""
    return F.call_function("instr", F.lit(_HEX), F.substring(F.md5(text), at, 1)) - 1


def url_captures(pages: DataFrame) -> DataFrame:
    """Fetch times over 2024 by page id."""
    return pages.select("page_id", "url", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int((page_id * 7919) % 365), int((page_id * 31) % 24))").alias("fetched_at"))


def url_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for some of the hosts, their parent domains and first path steps that occur in the pages."""
    seen = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.split(url_filter.path_of(F.col("url")), "/")[1].alias("step")).where("host <> ''").distinct()
    hosts = seen.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern"))
    parents = seen.select(F.lit("domain").alias("kind"), F.regexp_replace("host", r"^[^.]+\.", "").alias("pattern"))
    steps = seen.where("step <> ''").select(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "step").alias("pattern"))
    p = hosts.union(parents).union(steps).distinct().select("*", F.concat_ws(":", "kind", "pattern").alias("key"))
    p = p.select("kind", "pattern", *[_digit(F.col("key"), i + 1).alias(f"d{i}") for i in range(4)]).where("d0 < 6")
    name = "CASE WHEN d0 = 0 THEN 'allow' WHEN d0 < 3 THEN 'malware' ELSE 'adult' END"
    event = lambda day, action: p.selectExpr(f"{name} AS list_name", "kind", "pattern", f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int({day})) AS event_at", f"'{action}' AS action")
    return event("d1 * 20", "add").union(event("d1 * 20 + 30 + d2 * 10", "remove").join(p.where("d3 < 12").select("kind", "pattern"), ["kind", "pattern"], "left_semi").select("list_name", "kind", "pattern", "event_at", "action")).union(
        event("d1 * 20 + 60 + d2 * 10", "add").join(p.where("d3 < 6").select("kind", "pattern"), ["kind", "pattern"], "left_semi").select("list_name", "kind", "pattern", "event_at", "action")
    )


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.match(url_captures(pages), url_entries(pages))


OP6_SQL = r"""
WITH cap AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(((page_id * 7919) % 365)::INT) + to_hours(((page_id * 31) % 24)::INT) AS fetched_at,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/') AS steps
  FROM pages),
seen AS (SELECT DISTINCT host, steps[2] AS step FROM cap WHERE host <> ''),
pat AS (
  SELECT 'domain' AS kind, host AS pattern FROM seen
  UNION SELECT 'domain', regexp_replace(host, '^[^.]+\.', '') FROM seen
  UNION SELECT 'prefix', host || '/' || step FROM seen WHERE step <> ''),
dig AS (
  SELECT kind || ':' || pattern AS key,
         strpos('0123456789abcdef', substr(md5(kind || ':' || pattern), 1, 1)) - 1 AS d0,
         strpos('0123456789abcdef', substr(md5(kind || ':' || pattern), 2, 1)) - 1 AS d1,
         strpos('0123456789abcdef', substr(md5(kind || ':' || pattern), 3, 1)) - 1 AS d2,
         strpos('0123456789abcdef', substr(md5(kind || ':' || pattern), 4, 1)) - 1 AS d3
  FROM pat),
ent AS (SELECT *, CASE WHEN d0 = 0 THEN 'allow' WHEN d0 < 3 THEN 'malware' ELSE 'adult' END AS list_name FROM dig WHERE d0 < 6),
span AS (
  SELECT key, list_name, d1 * 20 AS a, CASE WHEN d3 < 12 THEN d1 * 20 + 30 + d2 * 10 ELSE 99999 END AS b FROM ent
  UNION ALL SELECT key, list_name, d1 * 20 + 60 + d2 * 10, 99999 FROM ent WHERE d3 < 6),
keys AS (
  SELECT page_id, fetched_at, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
  FROM cap, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE host <> ''
  UNION
  SELECT page_id, fetched_at, 'prefix:' || host || array_to_string(list_slice(steps, 1, i), '/')
  FROM cap, unnest(range(2, greatest(len(steps), 2) + 1)) AS t(i) WHERE host <> ''),
hit AS (
  SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, bool_or(list_name = 'allow') AS allowed
  FROM keys JOIN span USING (key)
  WHERE fetched_at >= TIMESTAMP '2024-01-01' + to_days(a::INT) AND fetched_at < TIMESTAMP '2024-01-01' + to_days(b::INT)
  GROUP BY page_id)
SELECT c.page_id, c.url, c.host, c.fetched_at, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(lists, '') AS lists,
       CASE WHEN coalesce(allowed, TRUE) THEN 'allow' ELSE 'block' END AS verdict
FROM cap c LEFT JOIN hit h USING (page_id)
"""


# -- 7: exact copies -------------------------------------------------------
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""


# -- 8: packing ------------------------------------------------------------
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# -- 10: mixing ------------------------------------------------------------
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), "epoch", "block", "block_place", "doc_place")


# -- 1: quality ------------------------------------------------------------
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


# -- 2: near copies --------------------------------------------------------
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("seq")


#: Views of the least node that each end of a link reaches.
_REACH = """
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS far FROM sym UNION SELECT reach.node, sym.b FROM reach JOIN sym ON sym.a = reach.far),
part AS (SELECT node, least(node, min(far)) AS component FROM reach GROUP BY node)
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingles FROM words),
-- documents of one set share its least document's links
head AS (SELECT shingles, min(doc_id) AS doc_id FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM sets WHERE len(shingles) > 0) GROUP BY shingles),
one AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM head),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common FROM one x JOIN one y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL)
  WHERE 100 * common >= 75 * (na + nb - common)
  UNION ALL SELECT head.doc_id, s.doc_id FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM sets) s JOIN head USING (shingles) WHERE head.doc_id < s.doc_id),
""" + _REACH + """
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM sets s LEFT JOIN part ON node = s.doc_id
"""


# -- 3: toxicity -----------------------------------------------------------
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


# -- 4: page texts ---------------------------------------------------------
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


# -- 5: near vectors -------------------------------------------------------
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.size * y.size) >= 0.95),
""" + _REACH + """,
links AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, v.vec_id) AS component_id, v.vec_id = coalesce(component, v.vec_id) AS kept
FROM v LEFT JOIN part ON node = v.vec_id LEFT JOIN links ON a = v.vec_id
"""


# -- 9: repeated passages --------------------------------------------------
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq FROM words, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
first AS (SELECT seq, min(doc_id) AS doc FROM win GROUP BY seq),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN first USING (seq) WHERE doc < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS body FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM words) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id
"""


# -- 11: manifest ----------------------------------------------------------
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


#: The table of CRC-32 by the rule of its polynomial, then one step for each digit.
_CRC = """
bits AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)
"""

OP11_SQL = f"""
WITH RECURSIVE {_CRC},
field AS (
  SELECT doc_id, lang, source, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 3 = 0 AS tampered
  FROM documents, crc),
body AS (
  SELECT *, coalesce(octet_length(doc_id::VARCHAR::BLOB) || ':' || doc_id, '-') || coalesce(octet_length(source::BLOB) || ':' || source, '-') || coalesce(octet_length(lang::BLOB) || ':' || lang, '-') || coalesce(octet_length(n_chars::VARCHAR::BLOB) || ':' || n_chars, '-') AS head
  FROM field),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(CASE WHEN tampered THEN low ELSE text END)) || ':' || CASE WHEN tampered THEN low ELSE text END, '-')) AS seen FROM body)),
tree AS (
  SELECT coalesce('=' || lang, '') AS t, 0 AS lvl, pos, leaf AS h, n FROM leaf
  UNION ALL SELECT t, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY t, lvl, pos // 8),
sub AS (SELECT t, lvl, h, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, h, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
node AS (
  SELECT t, lvl, pos, h, n FROM tree WHERE n > 1
  UNION ALL SELECT s.t, s.lvl + top.lvl, top.pos, top.h, top.n FROM sub s JOIN top ON top.n > 1),
runs AS (SELECT t, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM node GROUP BY ALL),
walk AS (
  SELECT doc_id, l.leaf, coalesce('=' || lang, '') AS t, 0 AS lvl, l.pos AS pos, l.n AS n, seen AS h, '' AS proof, false AS up FROM leaf l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.t, CASE WHEN w.n = 1 THEN w.lvl ELSE w.lvl + 1 END, CASE WHEN w.n = 1 THEN s.pos ELSE w.pos // 8 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 7) // 8 END,
         CASE WHEN w.n = 1 THEN w.h ELSE sha256(array_to_string(hs[1:(w.pos % 8)::INT], '') || w.h || array_to_string(hs[(w.pos % 8 + 2)::INT:], '')) END,
         CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || array_to_string(hs[1:(w.pos % 8)::INT], '') || array_to_string(hs[(w.pos % 8 + 2)::INT:], '') END, w.up OR w.n = 1
  FROM walk w JOIN sub s ON s.t = w.t LEFT JOIN runs r ON r.t = w.t AND r.lvl = w.lvl AND r.run = w.pos // 8 WHERE NOT (w.up AND w.n = 1))
SELECT w.doc_id, w.leaf, s.h AS subroot, root.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root.h AS verified
FROM walk w JOIN sub s ON s.t = w.t, (SELECT h FROM top WHERE n = 1) root WHERE w.up AND w.n = 1
"""


# -- 12: whitening ---------------------------------------------------------
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# -- 13: licenses ----------------------------------------------------------
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Every block against every template, without filters."""
    vocabulary, templates = licenses.prepare(licenses.TEMPLATES)
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"""
WITH phrase(label, size, words) AS (VALUES {", ".join(f"('{label}', {len(p.split())}, {p.split()})" for p, label in licenses.PHRASES.items())}),
template(template, label, least, width, size) AS (VALUES {quoted((i, t.label, t.least, t.width, len(t.words)) for i, t in enumerate(templates))}),
tword(template, word) AS (VALUES {quoted((i, vocabulary[w]) for i, t in enumerate(templates) for w in t.words)}),
doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
base AS (SELECT row, label, i FROM doc, phrase, unnest(range(0, len(ws) - size + 1)) t(i) WHERE len(ws) >= size AND ws[i + 1:i + size] = words),
bases AS (SELECT row, count(*) AS n, min(i) AS low, max(i) AS high, list(DISTINCT label) AS labels FROM base GROUP BY row),
word AS (SELECT row, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM doc),
held AS (SELECT row, template, word, i // (width // 2) AS b FROM word JOIN tword USING (word) JOIN template USING (template) UNION SELECT row, template, word, i // (width // 2) - 1 FROM word JOIN tword USING (word) JOIN template USING (template) WHERE i >= width // 2),
met AS (SELECT row, label, count(*) / size AS share FROM held JOIN template USING (template) GROUP BY row, template, b, label, size, least HAVING count(*) >= least),
mets AS (SELECT row, list(DISTINCT label) AS labels, max(share) AS best FROM met GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low AS first_word, high AS last_word, array_to_string(list_sort(coalesce(x.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(x.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM doc LEFT JOIN bases x USING (row) LEFT JOIN mets m USING (row)
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_html_extract": op4_html_extract,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op6_url_lists": op6_url_lists,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_license_scan": op13_license_scan,
}
ORACLE_SQL = {"op2_near_dedup": OP2_SQL, "op5_embedding_dedup": OP5_SQL, "op6_url_lists": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_license_scan": _license_sql()}
