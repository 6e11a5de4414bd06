"""Queries of the corpus operators on the shared tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, filteraudit, graphann, language, lexical, licenses, linededup, packing, sharding, simhash, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
it AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
itn AS (SELECT item_id, w, least(len(w), 10) AS n FROM it WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM itn)
),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
),
occ AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op3_decontaminate", DECONTAMINATE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _draw_sql(node: str, weight: float) -> str:
    digits = f"substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{node}'), 1, {sharding.DRAW_BITS // 4})"
    return f"ln((CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) + 0.5) / {float(2**sharding.DRAW_BITS)!r}) / {float(weight)!r}"


def _pick_sql(children: list[tuple[str, float, str]]) -> str:
    """The value of the child with the largest draw."""
    if len(children) == 1:
        return children[0][2]
    draws = ", ".join(_draw_sql(name, weight) for name, weight, _ in children)
    values = ", ".join(value for _, _, value in children)
    return f"list_extract([{values}], list_position([{draws}], list_max([{draws}])))"


def _tree_sql(tree: list[sharding.Shard]) -> str:
    nested: dict[str, dict[str, list[sharding.Shard]]] = {}
    for s in sorted(tree, key=lambda s: (s.region, s.rack, s.shard)):
        nested.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions = []
    for r, racks in nested.items():
        below = []
        for k, shards in racks.items():
            leaf = _pick_sql([(f"shard {r}/{k}/{s.shard}", s.weight, str(s.shard)) for s in shards])
            below.append((f"rack {r}/{k}", sum(s.weight for s in shards), leaf))
        regions.append((f"region {r}", sum(w for _, w, _ in below), _pick_sql(below)))
    return _pick_sql(regions)


SHARDS = sharding.even_tree(16)
# Checksums byte by byte from the table of the reflected polynomial; slots by id, which is unique in the shared tables.
SHARD_SQL = f"""
WITH RECURSIVE step AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM step WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
b AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT)) AS b
  FROM documents
),
p AS (
  SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) AS BIGINT) AS text_crc32,
    CAST({_tree_sql(SHARDS)} AS INTEGER) AS shard, CAST({_tree_sql(sharding.grow(SHARDS))} AS INTEGER) AS grown_shard
  FROM b, tab
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM p
"""


@query("op9_shard", SHARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS, sharding.grow(SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LICENSE_BASE_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
ph(label, p) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
hit AS (
  SELECT doc_id, label, s FROM (SELECT doc_id, label, w, p, unnest(range(0, len(w) - len(p) + 1)) AS s FROM d, ph WHERE len(w) >= len(p))
  WHERE w[s + 1:s + len(p)] = p
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(s) AS n_base, min(s) AS first_word, max(s) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id, w
"""


@query("op1_licenses")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query("op5_pack")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op4_topk", TOPK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# The SQL engine counts edits in bytes, so letters beyond ASCII become single unused bytes first.
LINE_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
  )
),
c AS (SELECT line, count(*) AS copies, min((doc_id, line_no)) AS class_at FROM l GROUP BY line),
t AS (
  SELECT class_at, length(line) AS n, translate(line, 'äöüßÄÖÜéèêàâçëîïôûùáíóúñÁÉÍÓÚÑÇÈÊÀ',
    concat('#$%&*+/<=>@[]^_`{|}~', chr(1), chr(2), chr(3), chr(4), chr(5), chr(6), chr(7), chr(8), chr(14), chr(15), chr(16), chr(17), chr(18), chr(19), chr(20), chr(21))) AS line
  FROM c WHERE length(line) >= 20
),
near AS (SELECT x.class_at AS a, y.class_at AS b FROM t x JOIN t y ON y.n BETWEEN x.n - 2 AND x.n + 2 AND x.class_at <> y.class_at AND levenshtein(x.line, y.line) <= 2),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
g AS (SELECT a, least(a, min(b)) AS group_at FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS links FROM near GROUP BY a)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS chars, copies, coalesce(links, 0) AS links,
  class_at[1] AS class_doc, CAST(class_at[2] AS INTEGER) AS class_line, coalesce(group_at, class_at)[1] AS group_doc,
  CAST(coalesce(group_at, class_at)[2] AS INTEGER) AS group_line, (doc_id, line_no) = coalesce(group_at, class_at) AS first
FROM l JOIN c USING (line) LEFT JOIN k ON k.a = class_at LEFT JOIN g ON g.a = class_at
"""


@query("op6_line_dedup", LINE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line, with the first of its equal lines and the first of its linked group."""
    found = linededup.line_classes(table(spark, sf_dir, "documents"))
    places = [F.col(f"{x}_at.{y}").alias(f"{x}_{z}") for x in ("class", "group") for y, z in (("doc_id", "doc"), ("line_no", "line"))]
    return found.select("doc_id", "line_no", "chars", "copies", "links", *places, "first")


# Captures made from the pages, four a page at most: the response itself; a later revisit by another spelling of the URL, with the
# entity tag or the date; a stale revisit whose tag differs; a revisit by digest just before the response.
RECORDS_SQL = """
SELECT page_id, page_id * 4 + k AS record_id, page_id * 1000 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 500000 WHEN 2 THEN 900000 ELSE -1 END AS captured_at,
  CASE WHEN k = 0 THEN 200 ELSE 304 END AS status,
  CASE WHEN k = 1 THEN concat(url, '#again') WHEN k = 2 THEN concat(url, '&utm_campaign=x') ELSE url END AS url,
  md5(coalesce(html, '')) AS digest, k
FROM pages CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) WHERE k < 2 OR (k = 2 AND page_id % 5 = 0) OR (k = 3 AND page_id % 7 = 0)
"""


def page_records(pages: DataFrame) -> DataFrame:
    kinds = F.filter(
        F.array(F.lit(0), F.lit(1), F.when(F.col("page_id") % 5 == 0, 2), F.when(F.col("page_id") % 7 == 0, 3)), lambda k: k.isNotNull()
    )
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.explode(kinds).alias("k"))
    k, page = F.col("k"), F.col("page_id")
    tag = F.concat(F.lit('"'), F.when(k == 2, F.reverse("digest")).otherwise(F.col("digest")), F.lit('"'))
    url = F.when(k == 1, F.concat("url", F.lit("#again"))).when(k == 2, F.concat("url", F.lit("&utm_campaign=x"))).otherwise(F.col("url"))
    tagged = (page % 3 != 2) & (k < 3)
    entries = F.array(
        F.struct(F.lit("Date").alias("key"), F.concat(F.lit("day "), page * 4 + k).alias("value")),
        F.struct(F.lit("Cache-Control").alias("key"), F.when(k == 0, "max-age=60").otherwise("max-age=120").alias("value")),
        F.struct(F.lit("Content-Length").alias("key"), F.when(k == 0, "full").otherwise("0").alias("value")),
        F.struct(F.lit("ETag").alias("key"), F.when(tagged, tag).alias("value")),
        F.struct(F.lit("Last-Modified").alias("key"), F.when(k < 3, F.concat(F.lit("day "), page)).alias("value")),
    )
    return rows.select(
        page.alias("page_id"),
        (page * 4 + k).alias("record_id"),
        url.alias("url"),
        (page * 1000 + F.when(k == 0, 0).when(k == 1, 500000).when(k == 2, 900000).otherwise(-1)).alias("captured_at"),
        F.when(k == 0, 200).otherwise(304).alias("status"),
        "digest",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("headers"),
    )


WARC_SQL = rf"""
WITH r0 AS ({RECORDS_SQL}),
r1 AS (SELECT *, trim(url) AS u FROM r0),
r2 AS (
  SELECT *, regexp_extract(u, '{warc.URL}', 2) AS host, regexp_extract(u, '{warc.URL}', 3) AS port, regexp_extract(u, '{warc.URL}', 4) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '{warc.URL}', 5), '&'),
      lambda a: a <> '' AND NOT regexp_matches(a, '{warc.TRACKING}'))), '&') AS args
  FROM r1
),
r AS (
  SELECT page_id, record_id, captured_at, status, digest, k,
    CASE WHEN u = '' THEN NULL WHEN host <> '' THEN concat(regexp_replace(lower(host), '^www\.', ''),
      CASE WHEN port IN ('', '80', '443') THEN '' ELSE concat(':', port) END, regexp_replace(path, '/+$', ''),
      CASE WHEN args = '' THEN '' ELSE concat('?', args) END) ELSE u END AS canonical_url,
    CASE WHEN page_id % 3 <> 2 AND k < 3 THEN CASE WHEN k = 2 THEN reverse(digest) ELSE digest END END AS tag,
    CASE WHEN k < 3 THEN page_id END AS day
  FROM r2
),
j AS (
  SELECT v.*, o.record_id AS o_id, o.tag AS o_tag, o.day AS o_day, o.digest AS o_digest, o.page_id AS o_page,
    row_number() OVER (PARTITION BY v.record_id ORDER BY o.captured_at DESC, o.record_id DESC) AS n
  FROM r v LEFT JOIN r o ON o.status = 200 AND o.canonical_url = v.canonical_url AND o.captured_at < v.captured_at
  WHERE v.status = 304
),
d AS (
  SELECT *, CASE WHEN tag IS NOT NULL THEN 'etag' WHEN day IS NOT NULL THEN 'last-modified' ELSE 'digest' END AS by_what,
    CASE WHEN tag IS NOT NULL THEN coalesce(tag = o_tag, false) WHEN day IS NOT NULL THEN coalesce(day = o_day, false)
      ELSE coalesce(digest = o_digest, false) END AS agrees
  FROM j WHERE n = 1
),
e AS (SELECT *, CASE WHEN o_id IS NULL THEN 'no_response' WHEN agrees THEN 'resolved' ELSE 'mismatch' END AS outcome FROM d)
SELECT record_id, canonical_url, captured_at, CASE WHEN outcome = 'resolved' THEN o_id END AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN by_what END AS matched_by,
  concat_ws(';', 'cache-control=max-age=120', concat('content-length=', CASE WHEN outcome = 'resolved' THEN 'full' ELSE '0' END),
    concat('date=day ', record_id),
    CASE WHEN coalesce(tag, CASE WHEN outcome = 'resolved' THEN o_tag END) IS NOT NULL
      THEN concat('etag="', coalesce(tag, CASE WHEN outcome = 'resolved' THEN o_tag END), '"') END,
    CASE WHEN coalesce(day, CASE WHEN outcome = 'resolved' THEN o_day END) IS NOT NULL
      THEN concat('last-modified=day ', coalesce(day, CASE WHEN outcome = 'resolved' THEN o_day END)) END) AS headers
FROM e
"""


@query("op7_warc_revisits", WARC_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(page_records(table(spark, sf_dir, "pages")))
    line = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(line, ";"))


# Cells of every subset of filters, then all orders as paths through the subsets.
AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
least AS (SELECT t, min(doc_id) AS least_id FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > least_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN least USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id
),
states AS (
  SELECT part, subset, sum(CASE WHEN mask & subset = 0 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN mask & subset = 0 THEN good ELSE 0 END) AS good,
    sum(CASE WHEN mask & subset = 0 THEN toxic ELSE 0 END) AS toxic
  FROM m, (SELECT CAST(range AS INTEGER) AS subset FROM range(32)) GROUP BY part, subset
),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
whole AS (
  SELECT part, letter, sum(CASE WHEN mask & bit <> 0 THEN 1 ELSE 0 END) AS fails, sum(CASE WHEN mask = bit THEN 1 ELSE 0 END) AS alone
  FROM m, f GROUP BY part, letter
),
orders AS (
  SELECT '' AS o, 0 AS used, 0 AS depth UNION ALL
  SELECT concat(o, letter), used + bit, depth + 1 FROM orders, f WHERE used & bit = 0
),
st AS (
  SELECT o AS filter_order, step, substr(o, step, 1) AS letter,
    (SELECT used FROM orders p WHERE p.depth = step - 1 AND p.o = substr(orders.o, 1, step - 1)) AS before
  FROM orders, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 6)) WHERE depth = 5
),
r AS (
  SELECT a.part, filter_order, step, st.letter, b.n AS kept, a.n - b.n AS removed, fails - (a.n - b.n) AS redundant, alone AS unique_fails,
    a.good - b.good AS good_lost, a.toxic - b.toxic AS toxic_lost
  FROM st JOIN f USING (letter) JOIN states a ON a.subset = before JOIN states b ON b.part = a.part AND b.subset = before + bit
  JOIN whole ON whole.part = a.part AND whole.letter = st.letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TERMS_SQL = (
    r"list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), "
    r"lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
)
LEXICAL_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS w FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
it AS (SELECT item_id, unnest({TERMS_SQL}) AS t FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, t, count(*) AS times FROM it GROUP BY item_id, t),
tf AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, w, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * size.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, size GROUP BY t, size.n),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * size.n) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), size GROUP BY item_id, doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op12_lexical_search", LEXICAL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_graph_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
