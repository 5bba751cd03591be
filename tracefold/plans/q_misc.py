"""Queries: histograms (A18, D1, S6), links (X4–X8) and the sample workload."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import hist, links, workload
from tracefold.plans.registry import register
from tracefold.sources.testdata import read_table

ROOT = "/apps/ui/"


def _bin_sql(spec: hist.HistSpec) -> str:
    x = spec.column
    return (f"CASE WHEN {x} < {spec.lo!r} THEN 0 WHEN {x} >= {spec.hi!r} THEN {spec.bins + 1} "
            f"ELSE least(CAST(floor((CAST({x} AS DOUBLE) - {spec.lo!r}) / CAST({spec.width!r} AS DOUBLE)) AS BIGINT) + 1, "
            f"{spec.bins}) END")


HIST_SQL = "\nUNION ALL\n".join(
    f"SELECT '{s.name}' AS hist, CAST({_bin_sql(s)} AS BIGINT) AS bin, count(*) AS count FROM lineitem "
    f"WHERE {s.column} IS NOT NULL GROUP BY 2" for s in hist.LINEITEM_HISTS)


@register("A18_histogram_fill", HIST_SQL)
def q_histogram(spark, sf_dir):
    return hist.histogram_fill(read_table(spark, sf_dir, "lineitem"), hist.LINEITEM_HISTS)


@register("D1_process_and_merge", HIST_SQL)
def q_process_and_merge(spark, sf_dir):
    df = hist.read_partitioned(spark, [f"{sf_dir}/lineitem.parquet"]).select(
        *{s.column for s in hist.LINEITEM_HISTS})
    return hist.process_and_merge(df, hist.numpy_fill(hist.LINEITEM_HISTS))


@register("D1_user_merge", HIST_SQL)
def q_user_merge(spark, sf_dir):
    """The same with a merge of the user's own, over many partials: a tree of merges."""
    df = hist.read_partitioned(spark, [f"{sf_dir}/lineitem.parquet"]).select(*{s.column for s in hist.LINEITEM_HISTS})
    return hist.process_and_merge(df.repartition(40), hist.numpy_fill(hist.LINEITEM_HISTS), merge=hist.add_counts)


@register("S6_read_partitioned",
          "SELECT count(*) AS num_rows, CAST(sum(l_quantity) AS DOUBLE) AS sum_quantity FROM lineitem")
def q_read_partitioned(spark, sf_dir):
    df = hist.read_partitioned(spark, [f"{sf_dir}/lineitem.parquet"])
    return df.agg(F.count(F.lit(1)).alias("num_rows"), F.sum("l_quantity").alias("sum_quantity"))


_LINKS = r"""
m AS (SELECT page_id, regexp_extract_all(html, '<(?:a|link)\b[^>]*?\bhref="[^"]*"|<(?:img|script)\b[^>]*?\bsrc="[^"]*"') AS l
      FROM pages),
lk AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(mm, '^<(\w+)', 1) AS tag,
              regexp_extract(mm, '\b(href|src)="', 1) AS attribute, regexp_extract(mm, '(?:href|src)="([^"]*)"', 1) AS value
       FROM (SELECT page_id, unnest(l) AS mm, generate_subscripts(l, 1) AS pos FROM m) u)
"""


def _join_sql(a: str, b: str) -> str:
    r = (f"concat(CASE WHEN starts_with({a}, '/') THEN '/' ELSE '' END, "
         f"concat_ws('/', nullif(trim({a}, '/'), ''), nullif(trim({b}, '/'), '')), "
         f"CASE WHEN ends_with({b}, '/') THEN '/' ELSE '' END)")
    return f"CASE WHEN {r} = '//' THEN '/' ELSE {r} END"


def _strip_sql(v: str) -> str:
    p = r"'^/proxy/application_\d+_\d+/(.*)'"
    return f"CASE WHEN regexp_matches({v}, {p}) THEN regexp_extract({v}, {p}, 1) ELSE {v} END"


@register("X6_extract_links", "WITH " + _LINKS.strip() + "\nSELECT * FROM lk")
def q_extract_links(spark, sf_dir):
    return links.extract_links(read_table(spark, sf_dir, "pages"))


@register("X4_url_path_join", "WITH " + _LINKS.strip() + f"""
SELECT page_id, pos, value, {_join_sql("'" + ROOT + "'", 'value')} AS joined,
       {_join_sql('value', "'/'")} AS with_slash FROM lk""")
def q_url_path_join(spark, sf_dir):
    lk = links.extract_links(read_table(spark, sf_dir, "pages"))
    return lk.select("page_id", "pos", "value", links.url_path_join(F.lit(ROOT), F.col("value")).alias("joined"),
                     links.url_path_join(F.col("value"), F.lit("/")).alias("with_slash"))


@register("X5_strip_proxy_prefix", "WITH " + _LINKS.strip() + f"""
, pv AS (SELECT page_id, pos, value, concat('/proxy/application_', page_id, '_', pos, value) AS proxied FROM lk)
SELECT page_id, pos, {_strip_sql('value')} AS plain, {_strip_sql('proxied')} AS stripped,
       {_join_sql("'" + ROOT + "'", _strip_sql('proxied'))} AS rewritten FROM pv""")
def q_strip_proxy(spark, sf_dir):
    lk = links.extract_links(read_table(spark, sf_dir, "pages"))
    pv = lk.withColumn("proxied", F.concat(F.lit("/proxy/application_"), F.col("page_id").cast("string"), F.lit("_"),
                                          F.col("pos").cast("string"), F.col("value")))
    return pv.select("page_id", "pos", links.strip_proxy_prefix(F.col("value")).alias("plain"),
                     links.strip_proxy_prefix(F.col("proxied")).alias("stripped"),
                     links.url_path_join(F.lit(ROOT), links.strip_proxy_prefix(F.col("proxied"))).alias("rewritten"))


# the pages as text: cut at double-quoted links, rewrite them, put together (the pages hold no other quoting)
_REWRITE = r"""
WITH cut AS (SELECT page_id, html, string_split_regex(html, '(?:href|src)="[^"]*"') AS between,
                    regexp_extract_all(html, '(?:href|src)="[^"]*"') AS found FROM pages),
each AS (SELECT page_id, between, unnest(list_concat(found, [''])) AS m, generate_subscripts(list_concat(found, ['']), 1) AS k FROM cut),
vals AS (SELECT *, regexp_extract(m, '="([^"]*)"', 1) AS v, regexp_extract(m, '^(href|src)', 1) AS name,
                regexp_extract(between[k], '<(\\w+)[^<>]*\\s$', 1) AS tag FROM each)
""".replace("\\\\", "\\")


@register("X7_rewrite_links", _REWRITE.strip() + f"""
SELECT page_id, string_agg(concat(between[k], CASE
         WHEN m = '' THEN '' WHEN name = 'href' AND tag IN ('a', 'link') OR name = 'src' AND tag IN ('img', 'script')
         THEN concat(name, '="', {_join_sql("'" + ROOT + "'", _strip_sql('v'))}, '"') ELSE m END), '' ORDER BY k) AS html
FROM vals GROUP BY page_id""")
def q_rewrite_links(spark, sf_dir):
    return links.rewrite_links(read_table(spark, sf_dir, "pages").select("page_id", "html"), ROOT)


@register("X8_rewrite_by_content_type")
def q_rewrite_by_type(spark, sf_dir):
    return links.rewrite_by_content_type(links.content_bodies(read_table(spark, sf_dir, "pages")), ROOT)


@register("X8_rewrite_scripts_styles", r"""
WITH js AS (SELECT page_id, unnest(regexp_extract_all(html, '<script[^>]*>([\s\S]*?)</script>', 1)) AS body,
                   generate_subscripts(regexp_extract_all(html, '<script[^>]*>([\s\S]*?)</script>', 1), 1) AS part
            FROM pages),
     css AS (SELECT page_id, unnest(regexp_extract_all(html, '<style[^>]*>([\s\S]*?)</style>', 1)) AS body,
                    generate_subscripts(regexp_extract_all(html, '<style[^>]*>([\s\S]*?)</style>', 1), 1) AS part
             FROM pages)
SELECT page_id, CAST(part AS BIGINT) AS part, 'application/javascript' AS content_type,
       replace(body, 'location.origin', 'location.origin +''""" + ROOT + r"""'' ') AS body FROM js
UNION ALL
SELECT page_id, CAST(part AS BIGINT), 'text/css', body FROM css""")
def q_rewrite_scripts(spark, sf_dir):
    b = links.content_bodies(read_table(spark, sf_dir, "pages"))
    return links.rewrite_by_content_type(b.where(~F.col("content_type").contains("text/html")), ROOT)


# -- sample workload over real columns: left = customer nation keys, right = supplier nation keys + 10
def _sides(spark, sf_dir):
    left = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("value"))
    right = read_table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 10).cast("long").alias("value"))
    return left, right


_SIDES = """
x AS (SELECT CAST(c_nationkey AS BIGINT) AS v FROM customer),
z AS (SELECT CAST(s_nationkey + 10 AS BIGINT) AS v FROM supplier),
r22 AS (SELECT CAST(x.v + z.v + 3 AS HUGEINT) AS v FROM x CROSS JOIN z),
r5 AS (SELECT v FROM r22 WHERE v % 2 = 0),
r6 AS (SELECT CAST(3 * v - 3 AS HUGEINT) AS v FROM z WHERE (3 * v - 3) % 2 <> 0)
"""


@register("J14_cross_pairs", "WITH " + _SIDES.strip() + """
SELECT CAST(v % 2 AS BIGINT) AS parity, CAST(count(*) AS VARCHAR) AS n_pairs, CAST(sum(v) AS VARCHAR) AS sum_values
FROM r22 GROUP BY 1""")
def q_cross_pairs(spark, sf_dir):
    return workload.cross_pair_stats(*_sides(spark, sf_dir))


@register("A19_workload_sum", "WITH " + _SIDES.strip() + """
, a AS (SELECT (SELECT count(*) FROM r5) AS n5, (SELECT coalesce(sum(v), 0) FROM r5) AS s5,
               (SELECT count(*) FROM r6) AS n6, (SELECT coalesce(sum(v), 0) FROM r6) AS s6,
               (SELECT count(*) FROM z) AS nz, (SELECT coalesce(sum(v), 0) FROM z) AS sz)
SELECT CAST(n5 AS VARCHAR) AS n_even_pairs, CAST(s5 AS VARCHAR) AS sum_even_pairs, CAST(n6 AS VARCHAR) AS n_odd_mapped,
       CAST(s6 AS VARCHAR) AS sum_odd_mapped, CAST(2 * CAST(n5 AS HUGEINT) * n6 + nz AS VARCHAR) AS n_values,
       CAST(CAST(n6 AS HUGEINT) * s5 + CAST(n5 AS HUGEINT) * s6 + sz AS VARCHAR) AS total
FROM a""")
def q_workload_sum(spark, sf_dir):
    return workload.sample_workload(*_sides(spark, sf_dir))


@register("J15_broadcast_lookup", """
SELECT r_name, count(*) AS num_customers FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q_broadcast_lookup(spark, sf_dir):
    nat = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"),
                                                   F.col("n_regionkey") == F.col("r_regionkey"))
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return workload.broadcast_lookup(cust, nat.select("n_nationkey", "r_name"), "n_nationkey").groupBy("r_name").agg(
        F.count(F.lit(1)).alias("num_customers"))


@register("U3_union_all", "WITH " + _SIDES.strip() + """
SELECT v AS value, count(*) AS n FROM (SELECT v FROM x UNION ALL SELECT v FROM z) u GROUP BY v""")
def q_union_all(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return left.unionAll(right).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register("X3_pairs_to_rows", """
SELECT value, count(*) AS n FROM (SELECT l_partkey AS value FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) u
GROUP BY value""")
def q_pairs_to_rows(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return workload.pairs_to_rows(li, "l_partkey", "l_suppkey").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register("P27_map_filter_count",
          "SELECT count(*) AS n_even_squares FROM lineitem WHERE (l_partkey * l_partkey) % 2 = 0")
def q_map_filter_count(spark, sf_dir):
    return workload.map_filter_count(read_table(spark, sf_dir, "lineitem"), "l_partkey")


@register("D4_repartition_cache", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def q_repartition_cache(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber").repartition("l_orderkey", "l_linenumber")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("A20_side_channel_sum", "SELECT sum(l_quantity) AS acc_sum, count(l_quantity) AS n_added FROM lineitem")
def q_side_channel(spark, sf_dir):
    return workload.side_channel_sum(read_table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity")
