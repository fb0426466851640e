"""Queries of catalogues, text sources, hashes and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashes as H
from ..sources import files as S
from ..sources.cubes import VOXEL, frames, load, voxels
from .registry import query


@query("q_catalog_search", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'part') AND (contains(lower(p_brand), '2') OR contains(lower(p_type), 'eco')) ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def q_catalog_search(spark, d):
    p = load(spark, d, "part")
    found = S.search(p, "p_name", F.array("p_brand", "p_type"), "part", ("2", "eco"))
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("q_catalog_sort", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS newest, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS oldest, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS largest, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS name FROM orders)
 SELECT o_orderkey AS id, CAST(newest AS INT) AS newest, CAST(oldest AS INT) AS oldest, CAST(largest AS INT) AS largest, CAST(name AS INT) AS name FROM o WHERE least(newest, oldest, largest, name) <= 20""")
def q_catalog_sort(spark, d):
    return S.sorted_tops(load(spark, d, "orders"), 20)


@query("q_gallery_filter", "SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size >= 40 THEN 'large' ELSE 'medium' END AS kind FROM part WHERE p_size <= 10 OR p_size >= 40")
def q_gallery_filter(spark, d):
    size = F.col("p_size")
    return load(spark, d, "part").where((size <= 10) | (size >= 40)).select(F.col("p_partkey").alias("id"), F.when(size <= 10, "small").when(size >= 40, "large").otherwise("medium").alias("kind"))


@query("q_html_extract", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs FROM pages")
def q_html_extract(spark, d):
    return S.scraped(load(spark, d, "pages"))


@query("q_sha_chain", """WITH h AS (SELECT source, doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT source, sha256(string_agg(h, '' ORDER BY doc_id)) AS files FROM h GROUP BY source)
 SELECT source, files, sha256(files || coalesce(lag(files) OVER (ORDER BY source), '')) AS chained FROM f""")
def q_sha_chain(spark, d):
    return S.hash_chain(load(spark, d, "documents").where("text IS NOT NULL"), "source", "doc_id", "text")


TREE = "".join(f", l{n} AS (SELECT lang, node >> 4 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM l{n - 1} GROUP BY lang, node >> 4)" for n in range(1, 9))


@query("q_hash_tree", f"""WITH h AS (SELECT lang, doc_id AS node, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
 l0 AS (SELECT lang, node, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY h)) END AS h FROM h GROUP BY lang, node){TREE}
 SELECT l8.lang, (SELECT count(*) FROM l0 WHERE l0.lang IS NOT DISTINCT FROM l8.lang) AS leaves, l8.h AS root FROM l8""")
def q_hash_tree(spark, d):
    """The root of each language's texts by doc_id."""
    return H.roots(H.hash_tree(load(spark, d, "documents"), "doc_id", "text", "lang"), "lang")


@query("q_raw_frames", f"WITH {VOXEL}, p AS (SELECT f, y, x, r, g, b FROM voxel) SELECT f, sha256(unhex(string_agg(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0'), '' ORDER BY y, x, r, g, b))) AS sha, count(*) AS n FROM p GROUP BY f")
def q_raw_frames(spark, d):
    return frames(voxels(spark, d)).select("f", F.sha2("rgb", 256).alias("sha"), "n")


@query("q_channel_order", f"WITH {VOXEL} SELECT f, y, x, b AS c0, g AS c1, r AS c2 FROM voxel")
def q_channel_order(spark, d):
    return voxels(spark, d).select("f", "y", "x", F.col("b").alias("c0"), F.col("g").alias("c1"), F.col("r").alias("c2"))


@query("q_point_cloud", f"WITH {VOXEL} SELECT printf('%d %d %d %d %d %d', x, y, f, r, g, b) AS line FROM voxel WHERE f % 4 = 0 AND y % 4 = 0 AND x % 4 = 0")
def q_point_cloud(spark, d):
    return S.point_cloud(voxels(spark, d), 4)


@query("q_move_text", """WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
 SELECT user_id, '(;GM[1]SZ[9]' || string_agg(';' || CASE WHEN k % 2 = 1 THEN 'B' ELSE 'W' END || '[' || chr(97 + CAST(event_id % 9 AS INT)) || chr(97 + CAST(event_id // 9 % 9 AS INT)) || ']', '' ORDER BY k) || ')' AS sgf FROM m GROUP BY user_id""")
def q_move_text(spark, d):
    return S.move_text(load(spark, d, "events"))


@query("q_json_fields", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_fields(spark, d):
    return load(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("q_formats", "SELECT p_partkey AS id, 'c' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '.bin' AS file, CASE WHEN p_size * 97 < 1024 THEN CAST(p_size * 97 AS VARCHAR) || ' B' ELSE CAST(p_size * 97 // 1024 AS VARCHAR) || ' KB' END AS size FROM part")
def q_formats(spark, d):
    p = F.col("p_partkey")
    return load(spark, d, "part").select(p.alias("id"), F.concat(F.lit("c"), F.lpad(p.cast("string"), 5, "0"), F.lit(".bin")).alias("file"), S.byte_size(F.col("p_size") * 97).alias("size"))


@query("q_retention", "SELECT user_id, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id")
def q_retention(spark, d):
    return S.retained(load(spark, d, "events"), "ts", 7).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("q_palette_switch", """WITH e AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN event_id % 7 END AS switch FROM events) SELECT id, CAST(coalesce(last_value(switch IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 0) AS INT) AS ref FROM e""")
def q_palette_switch(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 7).alias("switch"))
    return S.current_palette(e, "user_id", ["ts", "id"]).select("id", "ref")


@query("q_component_report", "SELECT source, count(*) AS n, count(*) FILTER (strlen(text) > 0) AS valid, round(avg(n_chars / greatest(1, strlen(text))::DOUBLE), 6) AS ratio, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def q_component_report(spark, d):
    t = load(spark, d, "documents").withColumn("n", F.octet_length("text"))
    return t.groupBy("source").agg(F.count("*").alias("c"), F.count_if(F.col("n") > 0).alias("valid"), F.round(F.avg(F.col("n_chars") / F.greatest(F.lit(1), F.col("n"))), 6).alias("ratio"), F.sum("n").cast("long").alias("bytes")).withColumnRenamed("c", "n")


@query("q_text_entropy", "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE strlen(text) > 0), k AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL), p AS (SELECT doc_id, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS p FROM k) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS symbols FROM p GROUP BY doc_id")
def q_text_entropy(spark, d):
    from ..operators.windows import shares

    c = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    p = F.col("share")
    return shares(c, "n", "doc_id").groupBy("doc_id").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.count("*").alias("symbols"))
