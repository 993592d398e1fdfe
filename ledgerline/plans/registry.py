"""Registered queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import coerce, signals, stats, text
from ledgerline.operators import funnel, hierarchy, incremental, memory, quality, verdicts
from ledgerline.plans.base import ORACLE_SQL, QUERIES, WILSON, query, r

STEPS = ["view", "signup", "click", "purchase", "error"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""SELECT user_id % 3 AS arm, """ + ", ".join(f"count(DISTINCT user_id) FILTER (event_type = '{s}') AS {s}" for s in STEPS) + " FROM events GROUP BY 1")
def funnel_unique_sessions(spark, t):
    events = t("events").select((F.col("user_id") % 3).alias("arm"), "event_type", "user_id")
    return funnel.unique_sessions(events, "arm", "event_type", "user_id", STEPS)


@query("""WITH c AS (SELECT user_id % 3 AS arm, count(DISTINCT user_id) FILTER (event_type='view') v, count(DISTINCT user_id) FILTER (event_type='click') c, count(DISTINCT user_id) FILTER (event_type='purchase') p FROM events GROUP BY 1)
SELECT arm, round(coalesce(c * 100.0 / nullif(v, 0), 0)::DOUBLE, 6) AS click_rate, round(coalesce(p * 100.0 / nullif(c, 0), 0)::DOUBLE, 6) AS purchase_rate, CASE WHEN coalesce(c * 100.0 / nullif(v, 0), 0) >= 2.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c WHERE v > 0""")
def funnel_rates(spark, t):
    events = t("events").select((F.col("user_id") % 3).alias("arm"), "event_type", "user_id")
    counts = funnel.unique_sessions(events, "arm", "event_type", "user_id", STEPS)
    got = funnel.rates(counts, {"click_rate": ("click", "view"), "purchase_rate": ("purchase", "click")}, "view")
    return got.select("arm", r("click_rate").alias("click_rate"), r("purchase_rate").alias("purchase_rate"), F.when(F.col("click_rate") >= 2.5, "PASS").otherwise("FAIL").alias("verdict"))


@query(f"""WITH c AS (SELECT source, sum(quality)::BIGINT k, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
w AS (SELECT *, greatest(0.0, {WILSON.format(s='-')}) lo, least(1.0, {WILSON.format(s='+')}) hi FROM c)
SELECT source, k, n, round(k / n::DOUBLE, 6) p, round(lo, 6) low, round(hi, 6) high, CASE WHEN k / n::DOUBLE >= 0.7 THEN 'PASS' ELSE 'FAIL' END verdict, lo < 0.7 AND 0.7 < hi inconclusive, CASE WHEN lo < 0.7 AND 0.7 < hi THEN 'INCONCLUSIVE' WHEN k / n::DOUBLE >= 0.7 THEN 'PASS' ELSE 'FAIL' END resolved FROM w""")
def wilson_quality_by_source(spark, t):
    joined = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    counts = joined.groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    out = counts.withColumns(stats.proportion(F.col("k"), F.col("n"), 0.7))
    return out.select("source", "k", "n", r("p").alias("p"), r("low").alias("low"), r("high").alias("high"), "verdict", "inconclusive", "resolved")


KAPPA = """SELECT {by} count(*) n, sum((quality = toxic)::INT) / count(*)::DOUBLE o, (sum(quality)::DOUBLE * sum(toxic) + sum(1 - quality)::DOUBLE * sum(1 - toxic)) / (count(*)::DOUBLE * count(*)) e FROM {rows} {group}"""


@query(f"WITH k AS ({KAPPA.format(by='', rows='labels', group='')}) SELECT n, round(o, 6) observed, round(e, 6) expected, round(CASE WHEN e >= 1 THEN 1.0 ELSE (o - e) / (1 - e) END, 6) kappa FROM k")
def kappa_quality_toxic(spark, t):
    return stats.kappa(t("labels"), "quality", "toxic").select("n", r("observed").alias("observed"), r("expected").alias("expected"), r("kappa").alias("kappa"))


@query(f"""WITH k AS ({KAPPA.format(by='lang,', rows='labels JOIN documents USING (doc_id)', group='GROUP BY lang')}), v AS (SELECT lang, n, CASE WHEN e >= 1 THEN 1.0 ELSE (o - e) / (1 - e) END kappa FROM k)
SELECT lang, n, round(kappa, 6) kappa, CASE WHEN kappa < 0.4 THEN 'poor' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'strong' END band FROM v""")
def kappa_by_language(spark, t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    return stats.kappa(rows, "quality", "toxic", ["lang"]).select("lang", "n", r("kappa").alias("kappa"), stats.kappa_band(F.col("kappa")).alias("band"))


@query("""WITH s(task) AS (VALUES ('A'), ('N'), ('R'), ('Z')), m AS (SELECT l_returnflag task, median(l_quantity) FILTER (l_linestatus='O') pq, median(l_quantity) FILTER (l_linestatus='F') aq, median(l_extendedprice) FILTER (l_linestatus='O') pe, median(l_extendedprice) FILTER (l_linestatus='F') ae FROM lineitem GROUP BY 1)
SELECT task, pq AS O_l_quantity, round(pe, 4) AS O_l_extendedprice, aq AS F_l_quantity, round(ae, 4) AS F_l_extendedprice, CASE WHEN pq IS NULL OR aq IS NULL OR pe IS NULL OR ae IS NULL THEN 'NO DATA' WHEN pq < aq AND pe < ae THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s LEFT JOIN m USING (task)""")
def median_wins(spark, t):
    out = verdicts.paired_wins(t("lineitem"), ["A", "N", "R", "Z"], "l_returnflag", "l_linestatus", ["l_quantity", "l_extendedprice"], better="O", base="F")
    return out.withColumns({c: r(c, 4) for c in ("O_l_extendedprice", "F_l_extendedprice")})


@query("""SELECT l_suppkey, round(100000.0 / median(l_quantity / l_extendedprice), 4) AS projected_s, max(l_quantity) AS basis, CASE WHEN 100000.0 / median(l_quantity / l_extendedprice) > 1.5e8 THEN 'FAIL' ELSE 'PROJECTION' END AS verdict FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1""")
def projection_100k(spark, t):
    seconds, basis = stats.projected_seconds("l_quantity", "l_extendedprice")
    out = t("lineitem").groupBy("l_suppkey").agg(seconds.alias("projected_s"), basis.alias("basis")).filter("projected_s IS NOT NULL")
    return out.select("l_suppkey", r("projected_s", 4).alias("projected_s"), "basis", F.when(F.col("projected_s") > 1.5e8, "FAIL").otherwise("PROJECTION").alias("verdict"))


def _runs(t):
    """Line items as benchmark runs: returned lines are resumes, open ones increments, the supplier is the device."""
    return t("lineitem").select(
        F.concat(F.lit("iPhone"), (F.col("l_suppkey") % 11 + 8).cast("string"), F.lit(","), F.col("l_suppkey").cast("string")).alias("device_model"), F.lit(None).cast("string").alias("chip"),
        F.when(F.col("l_returnflag") == "R", "resume").when(F.col("l_linestatus") == "O", "incremental").otherwise("cold").alias("run_type"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("delta_source"),
        (F.col("l_extendedprice") / 15).alias("wall_time_s"), (F.col("l_quantity") * 2000).alias("assets_indexed"), (F.col("l_tax") * 1000).alias("thermal_serious_s"), F.lit(0.0).alias("thermal_critical_s"),
        (F.col("l_quantity") * 4.1).alias("assets_reprocessed_after_resume"), F.lit(0.0).alias("delta_inserted"), F.floor(F.col("l_discount") * 10).cast("double").alias("delta_updated"), (F.col("l_quantity") * 40).alias("index_bytes_per_asset"),
        (F.col("l_discount") * 100).alias("battery_drain_pct_per_10k"), (F.col("l_quantity") * 60).alias("first_screen_stall_ms"), F.lit(False).alias("resumed_ok"), (F.col("l_linenumber") > 3).alias("index_state_recovered_after_kill"),
        ((F.col("l_suppkey") % 4 == 0) & (F.col("l_linenumber") == 7)).alias("required_full_rescan"),
    )


_RUNS = """r AS (SELECT 'iPhone' || (l_suppkey % 11 + 8) || ',' || l_suppkey device_model, l_suppkey % 11 + 8 family, CASE WHEN l_returnflag='R' THEN 'resume' WHEN l_linestatus='O' THEN 'incremental' ELSE 'cold' END run_type,
 l_extendedprice / 15 wall, l_quantity * 2000 n, l_tax * 1000 serious, l_quantity * 4.1::DOUBLE again, floor(l_discount * 10) upd, l_suppkey % 4 = 0 AND l_linenumber = 7 rescan, l_quantity * 40 ib, l_discount * 100 bat, l_quantity * 60 stall FROM lineitem),
g AS (SELECT device_model, any_value(family) family, max(wall) FILTER (run_type <> 'incremental' AND floor(n) >= 95000) worst, 100000.0 / median(floor(n) / wall) FILTER (run_type <> 'incremental' AND floor(n) > 0 AND wall > 0) proj,
 count(*) FILTER (run_type <> 'incremental') colds, sum(wall) FILTER (run_type <> 'incremental') wall, sum(serious) FILTER (run_type <> 'incremental') serious, count(*) FILTER (run_type = 'resume') resumes, max(again) FILTER (run_type = 'resume') again,
 count(*) FILTER (run_type = 'incremental') deltas, count(*) FILTER (run_type = 'incremental' AND rescan) rescans, max(CASE WHEN n > 0 THEN wall * 100 / n END) FILTER (run_type = 'incremental') per100, coalesce(bool_or(run_type = 'incremental' AND upd >= 1), false) saw FROM r GROUP BY 1),
v AS (SELECT *, CASE WHEN worst IS NOT NULL THEN CASE WHEN worst <= 5400 THEN 'PASS' ELSE 'FAIL' END WHEN proj IS NULL THEN 'NO DATA' WHEN proj > 5400 THEN 'FAIL' ELSE 'PROJECTION' END A1,
 CASE WHEN colds = 0 THEN 'NO DATA' WHEN serious / (CASE WHEN wall = 0 THEN 1 ELSE wall END) < 0.05 THEN 'PASS' ELSE 'FAIL' END A2, CASE WHEN resumes = 0 THEN 'NO DATA' WHEN again <= 200 THEN 'PASS' ELSE 'FAIL' END A3,
 CASE WHEN deltas = 0 THEN 'NO DATA' WHEN rescans > 0 OR per100 > 60 THEN 'FAIL' WHEN NOT saw THEN 'NO DATA' ELSE 'PASS' END A4, CASE WHEN family BETWEEN 9 AND 18 THEN family - 9 ELSE -1 END rk FROM g),
w AS (SELECT *, list_filter([CASE WHEN A1 <> 'PASS' THEN 'A1' END, CASE WHEN A2 <> 'PASS' THEN 'A2' END, CASE WHEN A3 <> 'PASS' THEN 'A3' END, CASE WHEN A4 <> 'PASS' THEN 'A4' END], lambda x: x IS NOT NULL) blocked FROM v)"""


@query(f"""WITH {_RUNS} SELECT device_model, A1, A2, A3, A4, rk::INT AS "rank", round(worst, 4) AS worst_s, round(proj, 4) AS projected_s, array_to_string(blocked, ',') AS blocked_by, len(blocked) = 0 AS supported FROM w""")
def budget_verdicts(spark, t):
    out = verdicts.device_verdicts(_runs(t))
    return out.select("device_model", "A1", "A2", "A3", "A4", "rank", r("worst_s", 4).alias("worst_s"), r("projected_s", 4).alias("projected_s"), F.array_join("blocked_by", ",").alias("blocked_by"), "supported")


@query(f"""WITH {_RUNS}, m AS (SELECT min(rk) FILTER (len(blocked) = 0 AND rk >= 0) mr FROM w), p AS (SELECT min(device_model) minimum FROM w, m WHERE len(blocked) = 0 AND rk = mr)
SELECT minimum, mr::INT AS minimum_rank, (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT unnest(blocked) b FROM w)) AS blocked_by, (SELECT count(*) FROM w, m WHERE rk >= 0 AND rk < mr) AS older_failed FROM m, p""")
def min_supported(spark, t):
    return verdicts.minimum_supported(verdicts.device_verdicts(_runs(t))).withColumn("blocked_by", F.array_join("blocked_by", ","))


def _customer_paths(t):
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(text.SEP, "r_name", "n_name", "c_mktsegment").alias("path"))


@query("""WITH p AS (SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT c_custkey, r_name path FROM p UNION ALL SELECT c_custkey, r_name || ' > ' || n_name FROM p UNION ALL SELECT c_custkey, r_name || ' > ' || n_name || ' > ' || c_mktsegment FROM p)
SELECT path, count(DISTINCT c_custkey) assets, count(*) entries FROM a GROUP BY 1""")
def hier_rollup_unique(spark, t):
    return hierarchy.roll_up(_customer_paths(t), "c_custkey")


def _order_entries(t):
    owner = t("customer").select("c_custkey", "c_mktsegment")
    rows = t("orders").join(owner, F.col("o_custkey") == F.col("c_custkey"))
    paths = F.array(F.concat(F.lit("Segment > "), F.col("c_mktsegment")), F.concat(F.lit("Timeline > "), F.year("o_orderdate").cast("string")), F.concat(F.lit("Segment > Priority > "), F.col("o_orderpriority")))
    return hierarchy.entries(rows.withColumn("paths", paths), "o_orderkey", "paths")


_ENTRIES = """e AS (SELECT o_orderkey, unnest(['Segment > ' || c_mktsegment, 'Timeline > ' || year(o_orderdate), 'Segment > Priority > ' || o_orderpriority]) path FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {_ENTRIES}, a AS (SELECT o_orderkey, path FROM e UNION ALL SELECT o_orderkey, split_part(path, ' > ', 1) FROM e UNION ALL SELECT o_orderkey, 'Segment > Priority' FROM e WHERE path LIKE 'Segment > Priority > %')
SELECT path, count(DISTINCT o_orderkey) assets, count(*) entries FROM a GROUP BY 1""")
def multi_index_entries(spark, t):
    return hierarchy.roll_up(_order_entries(t), "o_orderkey")


@query(f"""WITH {_ENTRIES} SELECT path, count(*) entries FROM e WHERE path NOT IN (SELECT 'Timeline > ' || y FROM range(1996, 2001) x(y)) AND path NOT IN (SELECT 'Segment > ' || s FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('MACHINERY')) q(s)) AND path NOT LIKE 'Segment > Priority > %' GROUP BY 1""")
def invalid_paths(spark, t):
    years = spark.range(1996, 2001).select(F.concat(F.lit("Timeline > "), F.col("id").cast("string")).alias("path"))
    named = [f"Segment > {s}" for s in SEGMENTS if s != "HOUSEHOLD"] + [f"Segment > Priority > {p}" for p in PRIORITIES]
    return hierarchy.invalid_paths(_order_entries(t), years.union(spark.createDataFrame([(p,) for p in named], "path string")))


@query("""SELECT lang AS path, doc_id, n_chars, rn AS "rank", greatest(c - 24, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) rn, count(*) OVER (PARTITION BY lang) c FROM documents) WHERE rn <= 24""")
def leaf_topk(spark, t):
    return hierarchy.leaf_view(t("documents").select(F.col("lang").alias("path"), "doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")])


@query("""WITH x(path, doc_id) AS (SELECT lang, max_by(doc_id, n_chars * 1000000 - doc_id) FROM documents GROUP BY 1 UNION ALL SELECT 'xx', -1) SELECT * FROM x WHERE path = 'xx'""")
def unreachable_targets(spark, t):
    docs = t("documents").select(F.col("lang").alias("path"), "doc_id", "n_chars")
    view = hierarchy.leaf_view(docs, [F.desc("n_chars"), F.asc("doc_id")])
    targets = docs.groupBy("path").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id")).union(spark.createDataFrame([("xx", -1)], "path string, doc_id long"))
    return hierarchy.unreachable(targets, view, "doc_id")


@query("""SELECT side, count(*) n, sum(n_chars)::BIGINT chars FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'usable' ELSE 'pilot' END side, n_chars FROM documents) GROUP BY 1""")
def usable_and_pilot(spark, t):
    good, docs = t("labels").filter("quality = 1").select("doc_id"), t("documents").select("doc_id", "n_chars")
    marked = incremental.flagged(docs, good, "doc_id", "usable")
    return marked.groupBy(F.when(F.col("usable"), "usable").otherwise("pilot").alias("side")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT * FROM (SELECT 'big' AS name, 0::BIGINT AS expected, count(*) FILTER (p_size > 60) got FROM part UNION ALL SELECT 'priced', count(*) , count(*) FILTER (p_retailprice > 0) FROM part UNION ALL SELECT 'economy', 1, count(*) FILTER (p_type = 'ECONOMY') FROM part), LATERAL (SELECT CASE WHEN got = expected THEN 'OK' ELSE 'FAIL' END AS status)""")
def constraint_check(spark, t):
    return quality.constraints(t("part"), {"big": (F.col("p_size") > 60, 0), "priced": (F.col("p_retailprice") > 0, F.count("*")), "economy": (F.col("p_type") == "ECONOMY", 1)})


@query("""SELECT event_type, round(sum(s), 3) AS seconds FROM (SELECT event_type, coalesce((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6, 0) s FROM events) GROUP BY 1""")
def dwell_by_state(spark, t):
    got = funnel.dwell(t("events"), ["user_id"], "ts", "event_type")
    return got.groupBy("event_type").agg(r(F.sum("seconds"), 3).alias("seconds"))


@query("""SELECT batch, count(*) n, min(event_id) AS "first", max(event_id) AS "last" FROM (SELECT event_id, floor((row_number() OVER (ORDER BY event_id) - 1) / 200)::BIGINT batch FROM events) GROUP BY 1""")
def checkpoint_batches(spark, t):
    return incremental.batch_numbers(t("events").select("event_id"), "event_id", 200).groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""SELECT count(*) FILTER (o_orderkey % 2 = 1) remaining, count(*) FILTER (o_orderkey % 2 = 0) skipped FROM orders""")
def resume_skip(spark, t):
    orders = t("orders").select("o_orderkey")
    left = incremental.resume(orders, orders.filter("o_orderkey % 2 = 0"), "o_orderkey")
    return left.agg(F.count("*").alias("remaining")).crossJoin(orders.filter("o_orderkey % 2 = 0").agg(F.count("*").alias("skipped")))


@query("""WITH o AS (SELECT o_orderkey k, o_totalprice v FROM orders) SELECT k, CASE WHEN k % 3 = 0 OR k % 4 = 1 THEN round(v * 2, 4) ELSE round(v, 4) END v FROM o WHERE NOT (k % 6 = 0) AND (k % 10 <> 9 OR k % 3 = 0 OR k % 4 = 1)""")
def delta_apply(spark, t):
    now = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"))
    index = t("orders").filter("o_orderkey % 10 <> 9").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    op = lambda where, name: t("orders").filter(where).select(F.col("o_orderkey").alias("k"), F.lit(name).alias("op"))
    changes = op("o_orderkey % 3 = 0", "update").union(op("o_orderkey % 4 = 1", "insert")).union(op("o_orderkey % 6 = 0", "delete")).union(spark.createDataFrame([(-5, "insert")], "k long, op string"))
    return incremental.apply_delta(index, changes, now, "k").select("k", r("v", 4).alias("v"))


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderstatus = 'O')""")
def owned_delete(spark, t):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    return incremental.owned_delete(orders, orders.filter("o_orderkey % 5 = 0"), orders.filter("o_orderstatus = 'O'"), "o_orderkey").select("o_orderkey")


@query("""SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id) n FROM events) WHERE n = 1 OR event_type = 'purchase'""")
def dedup_events(spark, t):
    events = t("events").withColumn("day", F.to_date("ts"))
    return funnel.first_of_each(events, ["user_id", "event_type", "day"], ["event_id"], F.col("event_type") == "purchase").select("event_id")


@query("""WITH d AS (SELECT doc_id, source = 'src3' s, (n_chars % 700) + 0 w, n_chars % 1500 h, least(1.0, length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0)::DOUBLE * 20) q FROM documents),
g AS (SELECT doc_id, CASE WHEN s THEN 'screenshot-subtype' WHEN w > 0 AND h > 0 AND h / nullif(w, 0)::DOUBLE > 1.6 AND h / nullif(w, 0)::DOUBLE < 2.4 THEN 'screen-aspect' WHEN coalesce(q, 0) > 0.55 THEN 'text-likelihood' ELSE 'gated-out' END reason FROM d)
SELECT reason, reason <> 'gated-out' AS run, count(*) n, sum(doc_id)::BIGINT ids FROM g GROUP BY 1, 2""")
def gate_decision(spark, t):
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    score = F.least(F.lit(1.0), F.try_divide(digits, F.length("text")) * 20)
    got = t("documents").select("doc_id", signals.gate(F.col("source") == "src3", F.col("n_chars") % 700, F.col("n_chars") % 1500, score).alias("g"))
    return got.groupBy("g.reason", "g.run").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT vec_id, list_sum([CASE WHEN embedding[i] > embedding[i + 1] THEN 1::HUGEINT << (63 - i) ELSE 0 END FOR i IN range(1, 64)])::BIGINT AS dhash FROM embeddings""")
def dhash_vectors(spark, t):
    return t("embeddings").select("vec_id", signals.neighbour_hash(F.col("embedding")).alias("dhash"))


@query("""WITH g AS (SELECT md5(text) h, n_chars, min(doc_id) original, count(*) n FROM documents GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, original, n AS copies FROM documents d JOIN g ON md5(d.text) = h AND d.n_chars = g.n_chars""")
def exact_duplicates(spark, t):
    docs = t("documents").select("doc_id", F.md5("text").alias("h"), "n_chars")
    return memory.exact_duplicates(docs, "doc_id", ["h", "n_chars"])


@query("""WITH c AS (SELECT doc_id, [least(ascii(x), 255) FOR x IN string_split(text, '')] l FROM documents), b AS (SELECT doc_id, unnest(l) // 16 AS bin, len(l) n FROM c WHERE len(l) >= 2), p AS (SELECT doc_id, max(k) AS peak FROM (SELECT doc_id, bin, count(*) k FROM b GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT doc_id, len(l) n, len(list_filter(list_zip(l[:-2], l[2:]), lambda z: abs(z[1] - z[2]) > 40)) AS edges FROM c WHERE len(l) >= 2)
SELECT doc_id, round(least(1.0, 1.5 * edges / (n - 1)::DOUBLE + 0.5 * peak / n::DOUBLE), 6) AS likelihood FROM e JOIN p USING (doc_id) UNION ALL SELECT doc_id, 0.0 FROM c WHERE len(l) < 2""")
def text_likelihood(spark, t):
    return t("documents").select("doc_id", r(text.likelihood(F.col("text"))).alias("likelihood"))


@query("""SELECT page_id, length(x) AS n, md5(x) AS h FROM (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '</(w:)?p>', chr(10), 'g'), '<(w:)?br[^>]*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\\n{3,}', chr(10) || chr(10), 'g') x FROM pages)""")
def html_to_text(spark, t):
    return t("pages").select("page_id", text.strip_tags(F.col("html")).alias("x")).select("page_id", F.length("x").alias("n"), F.md5("x").alias("h")).withColumn("n", F.col("n").cast("long"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) target FROM pages), k AS (SELECT DISTINCT list_extract(string_split(url, '/'), -1) name FROM pages), f AS (SELECT DISTINCT url FROM pages),
c AS (SELECT page_id, count(*) checked, count(*) FILTER (NOT (target IN (SELECT url FROM f) OR list_extract(string_split(target, '/'), -1) IN (SELECT name FROM k))) broken FROM l GROUP BY 1)
SELECT page_id, coalesce(checked, 0) checked, coalesce(broken, 0) broken, CASE WHEN coalesce(checked, 0) = 0 THEN 'WARN' WHEN broken > 0 THEN 'FAIL' ELSE 'OK' END status FROM pages LEFT JOIN c USING (page_id)""")
def page_links(spark, t):
    pages = t("pages")
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("target"))
    got = quality.resolve(refs, pages.select(F.col("url").alias("path"))).groupBy("page_id").agg(F.count("*").alias("checked"), F.count_if(~F.col("resolved")).alias("broken"))
    out = pages.select("page_id").join(got, "page_id", "left").na.fill(0, ["checked", "broken"])
    return out.withColumn("status", quality.status_of(F.col("checked"), F.col("broken")))


@query("""WITH w AS (SELECT conv_id, turn, split_part(text, ' ', 1) a, json_extract_string('{"k": 1}', '$.k') b FROM conversations) SELECT conv_id, turn, coalesce(try_cast(CASE WHEN regexp_full_match(a, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN trim(a) END AS DOUBLE), 0) AS value, lower(trim(a)) IN ('y', 'yes', 'true', '1') AS said_yes FROM w""")
def lenient_cast(spark, t):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return t("conversations").select("conv_id", "turn", coerce.number(first).alias("value"), coerce.yes(first).alias("said_yes"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events""")
def lenient_json(spark, t):
    return t("events").select("event_id", coerce.number(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g')) AS clean, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::BIGINT AS n FROM documents""")
def pii_split(spark, t):
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return funnel.private_text(t("documents").select("doc_id", "text"), "text", mail, "<email>").select("doc_id", F.md5("text").alias("clean"), F.col("private").alias("n"))


@query("""SELECT p_partkey, regexp_replace(replace(lower(p_type), ' ', '-'), '^-+|-+$', '', 'g') || '_' || regexp_replace(replace(replace(lower(p_name || ' & ' || p_brand), ' ', '-'), '&', 'and'), '^-+|-+$', '', 'g') AS slug FROM part""")
def slugs(spark, t):
    return t("part").select("p_partkey", text.slug(F.concat(F.col("p_type"), F.lit(text.SEP), F.col("p_name"), F.lit(" & "), F.col("p_brand"))).alias("slug"))


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') F, count(*) FILTER (o_orderstatus = 'O') O, count(*) FILTER (o_orderstatus = 'P') P FROM orders GROUP BY 1""")
def ordinal_matrix(spark, t):
    return verdicts.answers(t("orders"), F.col("o_orderpriority"), "priority", F.col("o_orderstatus"), ["F", "O", "P"])


@query("""SELECT round((avg((o_orderstatus='F')::INT) + avg((o_orderpriority='1-URGENT')::INT)) / 2, 6) AS low_risk, round((avg((o_orderstatus='F')::INT) + avg((o_orderpriority='5-LOW')::INT)) / 2, 6) AS high_risk, 'FLAT' AS gradient FROM orders""")
def gradient(spark, t):
    yes = lambda c: F.when(c, "auto").otherwise("ask")
    rows = t("orders").select(yes(F.col("o_orderstatus") == "F").alias("a"), yes(F.col("o_orderpriority") == "1-URGENT").alias("b"), yes(F.col("o_orderstatus") == "F").alias("c"), yes(F.col("o_orderpriority") == "5-LOW").alias("d"))
    return verdicts.gradient(rows, ["a", "b", "c", "d"]).select(r("low_risk").alias("low_risk"), r("high_risk").alias("high_risk"), "gradient")


@query("""SELECT v AS variant, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(v) LEFT JOIN (SELECT o_orderstatus v, count(*) n, round(sum(o_totalprice), 2) total FROM orders GROUP BY 1) USING (v)""")
def variant_spine(spark, t):
    got = t("orders").groupBy(F.col("o_orderstatus").alias("variant")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
    return verdicts.on_spine(spark, "variant", ["F", "O", "P", "X"], got, {"n": 0, "total": 0.0})


@query("""SELECT arm, variant, count(*) n FROM (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) % 2 AS arm, (row_number() OVER (ORDER BY c_custkey) - 1) % 4 AS variant FROM customer) GROUP BY 1, 2""")
def rota(spark, t):
    numbered = funnel.rota(t("customer").select("c_custkey", "c_name"), "c_custkey")
    return numbered.groupBy(F.col("arm_order").alias("arm"), "variant").agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(median(CASE WHEN value > 0 THEN value END) / 10, 6) AS per_1000 FROM events GROUP BY 1""")
def crossover_per_1000(spark, t):
    return verdicts.review_burden(t("events"), ["event_type"], "value").select("event_type", r("per_1000").alias("per_1000"))


@query("""SELECT category, coalesce(n, 0) n, round(coalesce(n, 0) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share, target, abs(coalesce(n, 0) / (SELECT count(*) FROM documents)::DOUBLE - target) <= 0.05 AS within FROM (VALUES ('en', 0.6::DOUBLE), ('fr', 0.15), ('de', 0.15), ('es', 0.1), ('it', 0.0)) v(category, target) LEFT JOIN (SELECT lang category, count(*) n FROM documents GROUP BY 1) USING (category)""")
def composition_vs_target(spark, t):
    targets = spark.createDataFrame([("en", 0.6), ("fr", 0.15), ("de", 0.15), ("es", 0.1), ("it", 0.0)], "category string, target double")
    return quality.composition(t("documents"), "lang", targets, 0.05).withColumn("share", r("share"))


_TRIPS = [("spring", "1996-03-01", "1996-04-15", "ASIA"), ("autumn", "1998-09-10", "1998-10-01", "EUROPE")]


@query("""WITH trip(trip, a, b, place) AS (VALUES ('spring', TIMESTAMP '1996-03-01', TIMESTAMP '1996-04-15', 'ASIA'), ('autumn', TIMESTAMP '1998-09-10', TIMESTAMP '1998-10-01', 'EUROPE'))
SELECT trip, count(*) n, min(o_orderkey) AS "first" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN trip ON place = r_name AND o_orderdate >= a AND o_orderdate < b + INTERVAL 1 DAY GROUP BY 1""")
def trip_membership(spark, t):
    trips = spark.createDataFrame(_TRIPS, "trip string, a string, b string, r_name string").withColumns({"a": F.to_timestamp_ntz("a", F.lit("yyyy-MM-dd")), "b": F.to_timestamp_ntz("b", F.lit("yyyy-MM-dd")) + F.expr("INTERVAL 1 DAY")})
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    owner = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(place), "c_nationkey")
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(owner, F.col("o_custkey") == F.col("c_custkey"))
    return memory.in_windows(rows, trips, "r_name", "o_orderdate").groupBy("trip").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_ids(spark, t):
    return quality.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_partkey AS k, count(*) n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) GROUP BY 1""")
def ref_integrity(spark, t):
    return quality.undefined(t("lineitem").select(F.col("l_partkey").alias("k")), t("part").filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k")), "k")


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END s, o_totalprice + (o_orderkey % 5 = 0)::INT p FROM orders WHERE o_orderkey % 17 <> 0)
SELECT status, count(*) n, sum(c)::BIGINT AS changes FROM (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS DISTINCT FROM s OR a.o_totalprice IS DISTINCT FROM p THEN 'changed' ELSE 'same' END status, CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN 0 ELSE (a.o_orderstatus IS DISTINCT FROM s)::INT + (a.o_totalprice IS DISTINCT FROM p)::INT END c FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) GROUP BY 1""")
def snapshot_compare(spark, t):
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    a = t("orders").filter("o_orderkey % 11 <> 0").select(columns)
    b = t("orders").filter("o_orderkey % 17 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + (F.col("o_orderkey") % 5 == 0).cast("int")).alias("o_totalprice"))
    return quality.compare(a, b, "o_orderkey").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("columns").cast("long")).alias("changes"))


@query("""SELECT lang, count(DISTINCT x) AS variants, count(*) AS n, count(DISTINCT x) = 1 AS equal FROM (SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) lang, md5(regexp_replace(regexp_replace(regexp_replace(html, '>[^<]+<', '><', 'g'), '<a [^>]*>', '<a>', 'g'), '<!--[^>]*-->', '', 'g')) x FROM pages) GROUP BY 1""")
def template_equality(spark, t):
    bare = text.skeleton(F.regexp_replace(F.regexp_replace("html", ">[^<]+<", "><"), "<a [^>]*>", "<a>"), ["<!--[^>]*-->"])
    return quality.all_equal(t("pages").withColumn("lang", F.regexp_extract("html", 'lang="([a-z]+)"', 1)), bare, ["lang"])


@query("""WITH c AS (SELECT lang AS category, count(*) n, count(*) FILTER (n_chars < 100) short FROM documents GROUP BY 1) SELECT category, CASE WHEN n = 0 THEN 'WARN' WHEN short > 0 THEN 'FAIL' ELSE 'OK' END AS status FROM c""")
def status_sorted(spark, t):
    got = t("documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 100).alias("short"))
    return quality.ranked(got.select("category", quality.status_of(F.col("n"), F.col("short")).alias("status")))


@query(f"""WITH c AS (SELECT 'quality' criterion, sum(quality)::BIGINT k, count(*) n, 0.7::DOUBLE threshold FROM labels UNION ALL SELECT 'clean', sum(1 - toxic)::BIGINT, count(*), 0.9 FROM labels UNION ALL SELECT 'none', 0, 0, 0.5),
d AS (SELECT criterion, k, n AS total, greatest(n, 1) AS n, threshold FROM c),
w AS (SELECT * REPLACE (total AS n), CASE WHEN total > 0 THEN greatest(0.0, {WILSON.format(s='-')}) ELSE 0 END lo, CASE WHEN total > 0 THEN least(1.0, {WILSON.format(s='+')}) ELSE 0 END hi, k / n::DOUBLE p FROM d)
SELECT criterion, k, n, round(p, 6) p, round(lo, 6) low, round(hi, 6) high, CASE WHEN p >= threshold THEN 'PASS' ELSE 'FAIL' END verdict, CASE WHEN n = 0 THEN 'NO DATA' WHEN lo < threshold AND threshold < hi THEN 'INCONCLUSIVE' WHEN p >= threshold THEN 'PASS' ELSE 'FAIL' END resolved FROM w""")
def gate_table(spark, t):
    counts = t("labels").agg(F.sum("quality").alias("kq"), F.sum(1 - F.col("toxic")).alias("kc"), F.count("*").alias("n")).withColumn("zero", F.lit(0).cast("long"))
    out = verdicts.criteria(counts, [("quality", "kq", "n", 0.7), ("clean", "kc", "n", 0.9), ("none", "zero", "zero", 0.5)])
    return out.select("criterion", "k", "n", r("p").alias("p"), r("low").alias("low"), r("high").alias("high"), "verdict", "resolved")


@query("""SELECT CASE WHEN count(*) < 15 THEN 'INCOMPLETE' WHEN avg(quality) >= 0.7 AND avg(1 - toxic) >= 0.9 THEN 'PASS' WHEN avg(quality) >= 0.7 THEN 'GO WITH CONSTRAINTS' ELSE 'FAIL' END AS verdict FROM labels""")
def overall_verdict(spark, t):
    rates = t("labels").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg(1 - F.col("toxic")).alias("c"))
    ok = lambda c, least: F.when(F.col(c) >= least, "PASS").otherwise("FAIL")
    return rates.select(verdicts.overall(F.col("n"), ok("q", 0.7), ok("c", 0.9)).alias("verdict"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60""")
def newest_60(spark, t):
    return hierarchy.library_scan(t("orders"), "o_orderdate", "o_orderkey", F.lit(False), newest=60).select("o_orderkey", "o_totalprice")


@query("""SELECT 'lang' AS kind, lang AS name, count(*) n, min(doc_id) AS "first" FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents GROUP BY 2""")
def group_members(spark, t):
    got = hierarchy.group_members(t("documents"), "doc_id", ["lang", "source"])
    return got.select("kind", "name", "n", F.col("members")[0].alias("first"))


@query("""SELECT user_id, count(*) n, count(DISTINCT g) AS bursts FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 gap FROM events)) GROUP BY 1""")
def moment_bursts(spark, t):
    runs = memory.sessions(t("events"), ["user_id"], "ts", 86400, ["event_id"])
    return runs.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("session").alias("bursts"))


@query("""WITH m AS (SELECT any_value(embedding) v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum([(embedding[i]::DOUBLE - v[i]) * (embedding[i]::DOUBLE - v[i]) FOR i IN range(1, 65)])), 6) AS distance FROM embeddings, m""")
def embedding_distance(spark, t):
    zero = t("embeddings").filter("vec_id = 0").select(F.col("embedding").alias("v"))
    return t("embeddings").crossJoin(F.broadcast(zero)).select("vec_id", r(signals.distance(F.col("embedding"), F.col("v"))).alias("distance"))  # one row


@query("""SELECT user_id % 3 AS arm, """ + ", ".join(f"count(DISTINCT user_id) FILTER (event_type = '{s}') AS {s}" for s in STEPS) + " FROM events GROUP BY 1")
def stream_funnel(spark, t):
    from ledgerline.streaming.funnel import streamed_funnel

    return streamed_funnel(spark, t("events"), STEPS)


@query("""SELECT o_custkey AS k, max(o_orderkey) AS "last" FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1""")
def stream_merge(spark, t):
    from ledgerline.storage import fresh
    from ledgerline.streaming.merge import streamed_latest

    path = fresh(spark, "orders")
    t("orders").select("o_custkey", "o_orderkey").repartition(3).write.parquet(path)
    return streamed_latest(spark, spark.read.parquet(path), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") % 7 == 0)


from ledgerline.plans import catalogue, decisions, studies, tables  # noqa: E402, F401  each adds its queries

query(decisions.statement_sql(_RUNS))(decisions.minimum_statements)
