"""File catalogs: P01, P02, P12, P13, A25-A28, J06-J09, J14, J15, J17, U04-U07, R03, F20-F30."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.operators import joins
from lumenweave.operators.index import global_index
from lumenweave.plans.registry import query, r
from lumenweave.plans.views import files, table, with_views

V = with_views("files")


@query("p01_facet_filter", f"{V} SELECT file_id, path FROM files WHERE filter = 'F606W' AND instrument = 'ACS' AND (date_obs = '' OR date_obs >= '1994-01-01') AND (date_obs = '' OR date_obs <= '1996-12-31')")
def p01(spark, sf):
    return joins.facet_filter(files(spark, sf), {"filter": "F606W", "instrument": "ACS", "proposal": ""}, "1994-01-01", "1996-12-31").select("file_id", "path")


PRODUCT = "CASE WHEN lower(path) LIKE '%\\_flc%' ESCAPE '\\' THEN 'flc' WHEN lower(path) LIKE '%\\_flt%' ESCAPE '\\' THEN 'flt' WHEN lower(path) LIKE '%\\_cal%' ESCAPE '\\' THEN 'cal' WHEN regexp_matches(lower(path), '(^|[0-9])[ns]20\\d\\d') THEN 'gemini' ELSE '' END"


@query("p02_product_type", f"{V} SELECT {PRODUCT} AS product, count(*) AS files FROM files GROUP BY 1")
def p02(spark, sf):
    return files(spark, sf).groupBy(s.product_type(F.col("path")).alias("product")).agg(F.count("*").alias("files"))


@query("p12_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def p12(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("p13_first_path", f"{V} SELECT min(file_id) AS file_id, lower(left(path, 3)) AS stem FROM files GROUP BY 2")
def p13(spark, sf):
    return joins.first_of_each(files(spark, sf), F.lower(F.substring("path", 1, 3)), "file_id").select("file_id", F.lower(F.substring("path", 1, 3)).alias("stem"))


def _facet_sql(facet: str) -> str:
    return f"""{V}, c AS (SELECT CASE WHEN trim({facet}) = '' THEN 'Unknown' ELSE trim({facet}) END AS value, count(*) AS files FROM files GROUP BY 1), k AS (SELECT *, TRY_CAST(nullif(regexp_extract(value, '^(\\d+(?:\\.\\d+)?)s?$', 1), '') AS DOUBLE) AS num FROM c),
a AS (SELECT value, files, row_number() OVER (ORDER BY num IS NULL, num, value) AS position FROM k UNION ALL SELECT 'Any', count(*), 0 FROM files) SELECT value, files, position, value || ' (' || files || ' files)' AS label FROM a"""


for _facet in ("filter", "proposal", "exposure", "instrument"):

    @query(f"a25_facet_{_facet}", _facet_sql(_facet))
    def _facet_counts(spark, sf, facet=_facet):
        return joins.facet_counts(files(spark, sf), F.col(facet))


@query("a26_files_by_filter", f"{V} SELECT filter, count(*) AS files, array_to_string(list_sort(list(path))[1:5], ',') AS first_paths FROM files GROUP BY 1")
def a26(spark, sf):
    # a filter's whole list can be large, so only its least paths are gathered
    rank = F.row_number().over(Window.partitionBy("filter").orderBy("path"))
    rows = files(spark, sf).withColumn("k", rank)
    least = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("path"))))
    return rows.groupBy("filter").agg(F.count("*").alias("files"), F.array_join(least, ",").alias("first_paths"))


@query("a27_distinct_dates", f"{V} SELECT DISTINCT date_obs FROM files WHERE date_obs <> ''")
def a27(spark, sf):
    return files(spark, sf).filter("date_obs <> ''").select("date_obs").distinct()


@query("a28_product_presence", f"{V}, p AS (SELECT instrument, {PRODUCT} AS product FROM files) SELECT instrument, bool_or(product = 'flc') AS flc, bool_or(product = 'flt') AS flt, bool_or(product = 'cal') AS cal FROM p GROUP BY 1")
def a28(spark, sf):
    p = files(spark, sf).withColumn("product", s.product_type(F.col("path")))
    return p.groupBy("instrument").agg(*[F.bool_or(F.col("product") == k).alias(k) for k in ("flc", "flt", "cal")])


@query(
    "j06_upsert",
    "WITH m AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), l AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(l.k, m.k) AS k, round(coalesce(l.v, m.v), 2) AS v, l.k IS NOT NULL AS loaded FROM m FULL JOIN l ON m.k = l.k",
)
def j06(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return joins.upsert(o.filter("k % 3 <> 0"), o.filter("k % 2 = 0").withColumn("v", F.col("v") * 2), "k").select("k", r("v", digits=2), "loaded")


@query(
    "j07_sidecar_identity",
    """WITH t AS (SELECT o_orderkey AS path, o_orderkey % 2 AS sci_ext, 64 AS width, 64 AS height, o_custkey AS size, o_orderkey * 10 AS mtime FROM orders),
sc AS (SELECT o_orderkey AS path, o_orderkey % 4 % 3 % 2 AS sci_ext, 64 AS width, CASE WHEN o_orderkey % 10 = 0 THEN 32 ELSE 64 END AS height, o_custkey AS size, o_orderkey * 10 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS mtime, o_orderkey % 9 <> 0 AS accepted FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN sc.size IS NULL THEN 'missing' WHEN sc.sci_ext <> t.sci_ext THEN 'mismatched' WHEN sc.width <> t.width OR sc.height <> t.height THEN 'mismatched' WHEN sc.size <> t.size OR sc.mtime <> t.mtime THEN 'stale' WHEN NOT sc.accepted THEN 'rejected' ELSE 'valid' END AS status, count(*) AS files
FROM t LEFT JOIN sc USING (path) GROUP BY 1""",
)
def j07(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    t = o.select(k.alias("path"), (k % 2).alias("sci_ext"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.col("o_custkey").alias("size"), (k * 10).alias("mtime"))
    sc = o.filter(k % 5 != 0).select(
        k.alias("path"), (k % 4 % 3 % 2).alias("sci_ext"), F.lit(64).alias("width"), F.when(k % 10 == 0, 32).otherwise(64).alias("height"),
        F.col("o_custkey").alias("size"), (k * 10 + F.when(k % 7 == 0, 1).otherwise(0)).alias("mtime"), (k % 9 != 0).alias("accepted"),
    )
    return joins.identity_status(t, sc).groupBy("status").agg(F.count("*").alias("files"))


@query(
    "j08_mask_pairing",
    """WITH sc AS (SELECT l_orderkey AS path, l_linenumber AS hdu, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_linenumber % 2 END AS extver, 64 AS width, 60 + l_orderkey % 2 AS height FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL),
mk AS (SELECT l_orderkey AS path, l_linenumber AS hdu, l_linenumber % 2 AS extver, 64 AS width, 60 + l_partkey % 2 AS height FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL)
SELECT s.path, s.hdu, min(m.hdu) AS mask_hdu FROM sc s LEFT JOIN mk m ON s.path = m.path AND s.width = m.width AND s.height = m.height AND (s.extver IS NULL OR s.extver = m.extver) GROUP BY 1, 2""",
)
def j08(spark, sf):
    li = table(spark, sf, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    sc = li.filter(n < 4).select(k.alias("path"), n.alias("hdu"), F.when(k % 3 != 0, n % 2).alias("extver"), F.lit(64).alias("width"), (k % 2 + 60).alias("height")).distinct()
    mk = li.filter(n >= 4).select(k.alias("path"), n.alias("hdu"), (n % 2).alias("extver"), F.lit(64).alias("width"), (F.col("l_partkey") % 2 + 60).alias("height")).distinct()
    return joins.pair_masks(sc, mk).select("path", "hdu", "mask_hdu")


@query(
    "j09_nearest_date",
    f"""{V}, sc AS (SELECT file_id, filter, instrument, CAST(date_obs AS DATE) AS day FROM files WHERE date_obs <> '' AND file_id % 4 <> 0), cb AS (SELECT file_id AS cal_id, filter, instrument, CAST(date_obs AS DATE) AS cal_day FROM files WHERE date_obs <> '' AND file_id % 4 = 0),
k AS (SELECT sc.file_id, cb.cal_id, abs(date_diff('day', cb.cal_day, sc.day)) AS gap, count(*) OVER (PARTITION BY sc.file_id) AS ensemble, row_number() OVER (PARTITION BY sc.file_id ORDER BY abs(date_diff('day', cb.cal_day, sc.day)), cal_id) AS r FROM sc JOIN cb USING (filter, instrument))
SELECT sc.file_id, k.cal_id, CAST(k.gap AS INTEGER) AS gap, k.ensemble FROM sc LEFT JOIN k ON k.file_id = sc.file_id AND k.r = 1""",
)
def j09(spark, sf):
    f = files(spark, sf).filter("date_obs <> ''").withColumn("day", F.to_date("date_obs"))
    science = f.filter("file_id % 4 <> 0").select("file_id", "filter", "instrument", "day")
    cal = f.filter("file_id % 4 = 0").select(F.col("file_id").alias("cal_id"), "filter", "instrument", "day")
    return joins.nearest_date(science, cal, ["filter", "instrument"]).select("file_id", "cal_id", "gap", "ensemble")


@query(
    "j14_weight_default",
    "WITH w AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_suppkey / 10.0 END AS weight FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_suppkey AS k, round(coalesce(weight, 1.0), 4) AS weight FROM supplier LEFT JOIN w ON k = s_suppkey",
)
def j14(spark, sf):
    sp = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    w = sp.filter("k % 2 = 0").select("k", F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("k") / 10).alias("weight"))
    return joins.weights_or_default(sp, w, "k", 1.0).select("k", r("weight"))


@query(
    "j15_propagate",
    """WITH f AS (SELECT l_orderkey AS path, l_linenumber AS chip, min(l_quantity) AS shift, l_linenumber % 3 = 1 AS aligned FROM lineitem GROUP BY 1, 2), o AS (SELECT path, arg_min(shift, chip) AS s FROM f WHERE aligned GROUP BY 1)
SELECT path, chip, round(CASE WHEN aligned THEN shift ELSE s END, 4) AS final, NOT aligned AND s IS NOT NULL AS inherited FROM f LEFT JOIN o USING (path)""",
)
def j15(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("chip")).agg(F.min("l_quantity").alias("shift")).withColumn("aligned", F.col("chip") % 3 == 1)
    return joins.propagate(f, "path", "chip", "aligned", "shift").select("path", "chip", r("final"), "inherited")


@query("j17_row_binding", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), f AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS j FROM o WHERE i % 3 <> 1) SELECT o_orderkey, i, j FROM f")
def j17(spark, sf):
    o = global_index(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "i")
    return global_index(o.filter("i % 3 <> 1"), ["i"], "j")


@query("u04_intersecting_sets", "WITH c AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT k, list_has_any(p, ['1-URGENT', '2-HIGH']) AS overlap FROM c")
def u04(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p"))
    return c.select("k", F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("overlap"))


@query("u05_rollup_any", f"{V} SELECT coalesce(filter, 'Any') AS filter, count(*) AS files FROM files GROUP BY ROLLUP (filter)")
def u05(spark, sf):
    return files(spark, sf).rollup("filter").agg(F.count("*").alias("files")).select(F.coalesce("filter", F.lit("Any")).alias("filter"), "files")


@query(
    "u06_revision_merge",
    """WITH s AS (SELECT c_custkey AS id, c_custkey % 5 AS rev, c_name AS audit, c_acctbal AS v FROM customer WHERE c_custkey % 4 <> 0), n AS (SELECT c_custkey AS id, c_custkey % 3 AS rev, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(s.id, n.id) AS id, s.audit, round(CASE WHEN n.id IS NULL OR n.rev < s.rev THEN s.v ELSE n.v END, 2) AS v, coalesce(n.rev < s.rev, false) AS rejected FROM s FULL JOIN n ON s.id = n.id""",
)
def u06(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    a = c.filter(k % 4 != 0).select(k.alias("id"), (k % 5).alias("rev"), F.col("c_name").alias("audit"), F.col("c_acctbal").alias("old"))
    b = c.filter(k % 3 != 0).select(k.alias("id"), (k % 3).alias("new_rev"), (F.col("c_acctbal") + 1).alias("new"))
    stale = F.coalesce(F.col("new_rev") < F.col("rev"), F.lit(False))
    return a.join(b, "id", "full").select("id", "audit", r(F.when(F.col("new").isNull() | stale, F.col("old")).otherwise(F.col("new")), "v", 2), stale.alias("rejected"))


@query("u07_anti_filter", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def u07(spark, sf):
    bad = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(bad, "o_orderkey", "left_anti").select("o_orderkey")


@query("r03_latest_generation", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def r03(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e"))
    return e.select("user_id", "e.event_id", "e.event_type")


@query("r02_job_status", "SELECT event_type AS status, date_trunc('hour', ts) AS hour, count(*) AS jobs FROM events GROUP BY 1, 2")
def r02(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("jobs"))


UNIT = "upper(replace(trim(u), ' ', ''))"


@query(
    "f20_unit_class",
    f"""WITH u AS (SELECT ['ELECTRONS/S', ' electrons ', 'MJy/sr', 'COUNTS', '', 'adu', 'e-/s', 'mag'][l_orderkey % 8 + 1] AS u, l_quantity AS q FROM lineitem)
SELECT CASE WHEN {UNIT} = '' THEN 'unknown' WHEN {UNIT} LIKE '%JY%' OR {UNIT} LIKE '%ERG%' OR {UNIT} LIKE '%MAG%' THEN 'calibrated' WHEN {UNIT} LIKE '%/S%' OR {UNIT} LIKE '%S-1%' THEN 'rate' WHEN {UNIT} IN ('ELECTRONS', 'ELECTRON', 'COUNTS', 'COUNT', 'DN', 'ADU', 'E-') THEN 'counts' ELSE 'unknown' END AS class, count(*) AS n, round(sum(q), 2) AS q FROM u GROUP BY 1""",
)
def f20(spark, sf):
    names = F.array(*[F.lit(k) for k in ("ELECTRONS/S", " electrons ", "MJy/sr", "COUNTS", "", "adu", "e-/s", "mag")])
    u = table(spark, sf, "lineitem").select(F.element_at(names, (F.col("l_orderkey") % 8 + 1).cast("int")).alias("u"), F.col("l_quantity").alias("q"))
    return u.groupBy(s.unit_class(F.col("u")).alias("class")).agg(F.count("*").alias("n"), r(F.sum("q"), "q", 2))


@query(
    "f21_exposure_label",
    """SELECT l_linenumber, l_quantity, CASE WHEN l_quantity - 3 > 0 THEN CAST(l_quantity - 3 AS BIGINT) || 's' ELSE 'Unknown' END AS label, CASE WHEN l_quantity - 3 > 0 THEN CAST(CAST(l_quantity - 3 AS BIGINT) AS DOUBLE) END AS seconds, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def f21(spark, sf):
    li = table(spark, sf, "lineitem")
    label = s.exposure_label(F.col("l_quantity").cast("double") - 3)
    return li.select("l_linenumber", "l_quantity", label.alias("label")).withColumn("seconds", s.exposure_seconds(F.col("label"))).groupBy("l_linenumber", "l_quantity", "label", "seconds").agg(F.count("*").alias("n"))


@query("f22_observation_date", f"{V}, d AS (SELECT CASE file_id % 4 WHEN 0 THEN date_obs || 'T01:02:03' WHEN 1 THEN date_obs WHEN 2 THEN replace(date_obs, '-', '/') ELSE '2001-02-31' END AS d FROM files) SELECT CASE WHEN regexp_matches(split_part(d, 'T', 1), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND TRY_CAST(split_part(d, 'T', 1) AS DATE) IS NOT NULL THEN split_part(d, 'T', 1) ELSE '' END AS day, count(*) AS n FROM d GROUP BY 1")
def f22(spark, sf):
    k = F.col("file_id") % 4
    d = F.when(k == 0, F.concat("date_obs", F.lit("T01:02:03"))).when(k == 1, F.col("date_obs")).when(k == 2, F.replace("date_obs", F.lit("-"), F.lit("/"))).otherwise("2001-02-31")
    return files(spark, sf).groupBy(s.observation_date(d).alias("day")).agg(F.count("*").alias("n"))


@query(
    "f23_filter_name",
    f"""{V}, k AS (SELECT CASE file_id % 5 WHEN 0 THEN 'F187N' WHEN 1 THEN 'CLEAR' ELSE '' END AS pupil, CASE file_id % 3 WHEN 0 THEN 'CLEAR1L' WHEN 1 THEN '123' ELSE filter END AS a, CASE WHEN file_id % 7 = 0 THEN 'OPEN' ELSE lower(filter) END AS b FROM files),
u AS (SELECT pupil, CASE WHEN a <> '' AND a NOT LIKE 'CLEAR%' AND a NOT IN ('OPEN', 'NONE', 'N/A', 'UNKNOWN') AND NOT regexp_matches(a, '^\\d+$') THEN a END AS a, CASE WHEN upper(b) NOT IN ('OPEN') THEN upper(b) END AS b FROM k)
SELECT CASE WHEN regexp_matches(pupil, '^F\\d') THEN pupil ELSE coalesce(a, b, 'Unknown') END AS name, count(*) AS n FROM u GROUP BY 1""",
)
def f23(spark, sf):
    i = F.col("file_id")
    pupil = F.when(i % 5 == 0, "F187N").when(i % 5 == 1, "CLEAR").otherwise("")
    a = F.when(i % 3 == 0, "CLEAR1L").when(i % 3 == 1, "123").otherwise(F.col("filter"))
    b = F.when(i % 7 == 0, "OPEN").otherwise(F.lower("filter"))
    return files(spark, sf).groupBy(s.filter_name(pupil, a, b).alias("name")).agg(F.count("*").alias("n"))


@query(
    "f24_bandpass",
    f"""{V}, k AS (SELECT filter, instrument, CASE WHEN file_id % 10 = 0 THEN 5921.1 ELSE 0.0 END AS p FROM files), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(filter, '^F(\\d{{3,4}})(W2|W|M|N|LP|X)$', 1), '') AS DOUBLE) AS num FROM k)
SELECT filter, instrument, round(CASE WHEN p > 0 THEN p / 10 WHEN instrument = 'WFC3' AND num < 200 THEN num * 10 ELSE num END, 3) AS nm, count(*) AS n FROM n GROUP BY ALL""",
)
def f24(spark, sf):
    p = F.when(F.col("file_id") % 10 == 0, 5921.1).otherwise(0.0)
    return files(spark, sf).groupBy("filter", "instrument", r(s.bandpass_nm(F.col("filter"), F.col("instrument"), p), "nm", 3)).agg(F.count("*").alias("n"))


@query("f26_section", "SELECT l_linenumber, CAST(sum(l_linenumber * 4) AS BIGINT) AS x2, CAST(sum(1 + l_linenumber) AS BIGINT) AS y1 FROM lineitem GROUP BY 1")
def f26(spark, sf):
    n = F.col("l_linenumber")
    text = F.format_string("[1:%d,%d:99]", n * 4, n + 1)
    x1, x2, y1, _ = s.section(text)
    return table(spark, sf, "lineitem").filter(x1 == 1).groupBy("l_linenumber").agg(F.sum(x2).alias("x2"), F.sum(y1).alias("y1"))


@query("f29_fingerprint", "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1")
def f29(spark, sf):
    item = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    recipe = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("t")))), lambda x: x["t"]), "|")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sha2(recipe, 256).alias("fingerprint"))


@query("f30_safe_name", "SELECT p_partkey, regexp_replace(trim(p_name || ' / ' || p_type), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM part")
def f30(spark, sf):
    return table(spark, sf, "part").select("p_partkey", s.safe_name(F.concat("p_name", F.lit(" / "), "p_type")).alias("name"))
