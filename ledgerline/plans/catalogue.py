"""Catalogues, memories and the staged index over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import signals, text
from ledgerline.operators import hierarchy, incremental, memory
from ledgerline.plans.base import query, r

TREE = {"Documents": {"_icon": "d", "IDs": {"_also_in": ["Travel"]}, "Bills": {"Gas": {}, "Water": {}}}, "Travel": {"Lisbon": {}}, "Work": {}}
_NODES = """(VALUES ('Documents', 'Documents', 1, false, 0), ('Documents > IDs', 'IDs', 2, true, 1), ('Documents > Bills', 'Bills', 2, false, 2), ('Documents > Bills > Gas', 'Gas', 3, true, 3), ('Documents > Bills > Water', 'Water', 3, true, 4), ('Travel', 'Travel', 1, false, 5), ('Travel > Lisbon', 'Lisbon', 2, true, 6), ('Work', 'Work', 1, true, 7)) n(path, name, depth, is_leaf, ordinal)"""


@query(f"""SELECT path, name, depth::INT AS depth, is_leaf, ordinal::INT AS ordinal, CASE WHEN name = 'IDs' THEN 'Travel' ELSE '' END AS also_in FROM {_NODES}""")
def taxonomy(spark, t):
    nodes = hierarchy.flatten_tree(spark, TREE)
    return nodes.select("path", "name", "depth", "is_leaf", "ordinal", F.array_join(F.coalesce("also_in", F.array().cast("array<string>")), ",").alias("also_in"))


@query(f"""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Documents > IDs' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Nowhere' ELSE 'Documents > Bills > Gas' END path FROM orders) SELECT p.path, depth::INT AS depth, is_leaf, count(*) n FROM p LEFT JOIN {_NODES} ON p.path = n.path GROUP BY 1, 2, 3""")
def node_lookup(spark, t):
    k = F.col("o_orderkey") % 4
    paths = t("orders").select(F.when(k == 0, "Documents > IDs").when(k == 1, "Travel").when(k == 2, "Nowhere").otherwise("Documents > Bills > Gas").alias("path"))
    return hierarchy.lookup(paths, hierarchy.flatten_tree(spark, TREE)).groupBy("path", "depth", "is_leaf").agg(F.count("*").alias("n"))


@query(f"""SELECT path FROM {_NODES} WHERE is_leaf UNION SELECT 'Timeline > ' || y FROM range(2015, 2031) x(y)""")
def valid_paths(spark, t):
    return hierarchy.valid_paths(hierarchy.flatten_tree(spark, TREE).filter("is_leaf"), range(2015, 2031))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'a|b' ELSE 'a|b|c' END AS paths FROM customer""")
def paths_with(spark, t):
    return t("customer").select("c_custkey", F.array_join(hierarchy.with_path(F.array(F.lit("a"), F.lit("b")), F.when(F.col("c_nationkey") % 2 == 0, "b").otherwise("c")), "|").alias("paths"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1""")
def first_targets(spark, t):
    return hierarchy.first_targets(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey FROM orders""")
def target_ids(spark, t):
    return hierarchy.target_ids(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate").withColumn("position", F.col("position").cast("long"))


@query("""SELECT c_custkey, n_name AS city, r_name AS country FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey""")
def place_lookup(spark, t):
    places = t("nation").filter("n_nationkey % 5 <> 0").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    return hierarchy.placed(t("customer").select("c_custkey", "c_nationkey"), places, "c_nationkey").select("c_custkey", "city", "country")


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey FROM orders WHERE o_orderstatus <> 'P' QUALIFY place <= 200""")
def library_prefix(spark, t):
    got = hierarchy.library_scan(t("orders"), "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "P", first=200)
    return incremental.batch_numbers(got.select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("k")), "k", 1).select((F.col("batch") + 1).alias("place"), "o_orderkey")


@query("""SELECT count(*) n, count(*) FILTER (o_orderkey % 7 = 0) AS synthetic, sum(o_orderkey)::BIGINT AS ids FROM orders""")
def flag_synthetic(spark, t):
    marked = incremental.flagged(t("orders").select("o_orderkey"), t("orders").filter("o_orderkey % 7 = 0").select("o_orderkey"), "o_orderkey")
    return marked.agg(F.count("*").alias("n"), F.count_if("synthetic").alias("synthetic"), F.sum("o_orderkey").alias("ids"))


@query("""SELECT x AS id, x % 100 < 25 AS has_text FROM range(1000) r(x)""")
def synthetic_assets(spark, t):
    return hierarchy.synthetic_assets(spark, 1000, 0.25)


@query("""SELECT * FROM (VALUES ('Documents > IDs', 500::BIGINT), ('Work', 1), ('Travel > Lisbon', 499)) v("primary", n)""")
def generated_library(spark, t):
    made = hierarchy.generate_library(spark, 1000, {"Documents > IDs": 0.5, "Work": 0.0001, "Travel > Lisbon": 0.7})
    return made.groupBy("primary").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) rn, count(*) OVER (PARTITION BY lang) c FROM documents)
SELECT lang AS path, '<h1>' || lang || '</h1><ol>' || string_agg('<li>' || doc_id || '</li>', '' ORDER BY rn) || '</ol>' || CASE WHEN max(c) > 24 THEN '<p>' || (max(c) - 24) || ' more</p>' ELSE '' END AS html FROM v WHERE rn <= 24 GROUP BY 1""")
def catalogue_pages(spark, t):
    view = hierarchy.leaf_view(t("documents").select(F.col("lang").alias("path"), "doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")])
    return hierarchy.page_html(view, "doc_id")


_ASSETS = """a AS (SELECT doc_id, doc_id % 13 = 0 missing, source = 'src3' s, n_chars % 700 w, n_chars % 1500 h, (n_chars % 10) / 10.0::DOUBLE q, text FROM documents),
g AS (SELECT *, CASE WHEN missing THEN 'missing' WHEN s THEN 'screenshot-subtype' WHEN w > 0 AND h > 0 AND h / nullif(w, 0)::DOUBLE > 1.6 AND h / nullif(w, 0)::DOUBLE < 2.4 THEN 'screen-aspect' WHEN q > 0.55 THEN 'text-likelihood' ELSE 'gated-out' END reason FROM a)"""


def _indexed(t):
    docs = t("documents")
    assets = docs.select("doc_id", "text", (F.col("doc_id") % 13 == 0).alias("missing"), (F.col("source") == "src3").alias("screenshot"), (F.col("n_chars") % 700).alias("width"), (F.col("n_chars") % 1500).alias("height"), ((F.col("n_chars") % 10) / 10.0).alias("score"))
    return memory.index_assets(assets, lambda some: some.withColumns({"digits": F.regexp_count("text", F.lit("[0-9]")), "cost": F.length("text") * 0.5}))


@query(f"""WITH {_ASSETS} SELECT doc_id, reason, missing AS failed, reason NOT IN ('missing', 'gated-out') AS attempted, CASE WHEN reason NOT IN ('missing', 'gated-out') THEN length(regexp_replace(text, '[^0-9]', '', 'g')) END AS digits FROM g""")
def index_assets(spark, t):
    return _indexed(t).select("doc_id", "reason", "failed", "attempted", F.col("digits").cast("long").alias("digits"))


@query(f"""WITH {_ASSETS} SELECT count(*) indexed, count(*) FILTER (reason NOT IN ('missing', 'gated-out')) attempted, count(*) FILTER (reason = 'gated-out') gated_out, count(*) FILTER (missing) failed, round(avg(length(text) * 0.5) FILTER (reason NOT IN ('missing', 'gated-out')), 4) cost_per_attempt FROM g""")
def stage_counters(spark, t):
    return memory.stage_counters(_indexed(t), "cost").withColumn("cost_per_attempt", r("cost_per_attempt", 4))


@query("""WITH d AS (SELECT doc_id, n_chars % 97 h, md5(text) m FROM documents), f AS (SELECT h, m, min(doc_id) f FROM d WHERE h <> 0 GROUP BY 1, 2) SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS linked_to, coalesce(f <> doc_id, false) AS dedup_skipped FROM d LEFT JOIN f USING (h, m)""")
def skip_duplicates(spark, t):
    docs = t("documents").select("doc_id", (F.col("n_chars") % 97).alias("h"), F.md5("text").alias("m"))
    return memory.skip_duplicates(docs, "doc_id", "h", "m").select("doc_id", "linked_to", "dedup_skipped")


@query("""WITH c AS (SELECT DISTINCT c_nationkey::BIGINT * 64 + c_custkey % 64 h FROM customer) SELECT x.h a, y.h b, bit_count(xor(x.h, y.h))::INT AS distance FROM c x JOIN c y ON x.h < y.h WHERE x.h <> 0 AND bit_count(xor(x.h, y.h)) <= 2""")
def near_hashes(spark, t):
    classes = t("customer").select((F.col("c_nationkey").cast("long") * 64 + F.col("c_custkey") % 64).alias("h")).distinct()
    return memory.near_hashes(classes, "h", 2)


@query("""WITH e AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) v FROM embeddings) SELECT vec_id, list_sum([CASE WHEN v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2] THEN CASE WHEN i = 0 THEN (-9223372036854775808)::HUGEINT ELSE 1::HUGEINT << (63 - i) END ELSE 0 END FOR i IN range(0, 64)])::BIGINT AS dhash FROM e""")
def difference_hashes(spark, t):
    levels = F.concat("embedding", F.slice("embedding", 1, 8))
    return t("embeddings").select("vec_id", signals.difference_hash(levels).alias("dhash"))


@query("""WITH s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) moment FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 43200 THEN 1 ELSE 0 END n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
b AS (SELECT user_id, moment, arg_min(event_id, (-value, event_id)) rep, arg_min(event_type, (-value, event_id)) kind FROM s GROUP BY 1, 2)
SELECT count(*) n, count(*) FILTER (event_id = rep) kept, count(*) FILTER (event_type = kind AND event_id <> rep) stand_back, round(count(*) FILTER (event_type <> kind) / count(*)::DOUBLE, 6) value_loss_rate FROM s JOIN b USING (user_id, moment)""")
def same_moments(spark, t):
    grouped = memory.moments(t("events"), ["user_id"], "ts", 43200, "event_id", "value", "event_type")
    return memory.value_loss(grouped, "event_id").withColumn("value_loss_rate", r("value_loss_rate"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 s, CASE WHEN event_type = 'purchase' THEN 'p' || event_id % 5 END p FROM events),
n AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN {'p': p, 's': s} END IGNORE NULLS) OVER b bk, last_value(CASE WHEN p IS NOT NULL THEN {'p': p, 's': s} END IGNORE NULLS) OVER a ah FROM e WINDOW b AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY s DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT event_id, p, s - bk.s db, ah.s - s da, bk.p bp, ah.p ap FROM n), f AS (SELECT *, db IS NOT NULL AND (da IS NULL OR db <= da) nb FROM d), g AS (SELECT *, CASE WHEN nb THEN db ELSE da END far, CASE WHEN nb THEN bp ELSE ap END gp FROM f)
SELECT event_id, coalesce(p, CASE WHEN far < 172800 THEN gp END) AS place, CASE WHEN p IS NOT NULL THEN 'gps' WHEN far < 172800 THEN 'neighbour' ELSE 'unknown' END AS place_source, round(CASE WHEN p IS NOT NULL THEN 1.0 WHEN far < 172800 THEN 1 - far / 172800 ELSE 0 END, 4) AS place_confidence FROM g""")
def inferred_places(spark, t):
    rows = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string"))).alias("place"))
    got = memory.inferred_places(rows, ["user_id"], "ts", "place", "event_id", 172800)
    return got.select("event_id", "place", "place_source", r("place_confidence", 4).alias("place_confidence"))


@query("""WITH s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) trip FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 604800 OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
SELECT user_id, event_type AS place, min(ts) AS "start", max(ts) AS "end", count(*) n FROM s WHERE event_type <> 'view' GROUP BY user_id, trip, event_type HAVING count(*) >= 2""")
def trips(spark, t):
    rows = t("events").select("user_id", "ts", "event_id", F.col("event_type").alias("place"), F.lit("view").alias("home"))
    return memory.trips(rows, ["user_id"], "ts", "place", "event_id", 604800, "home").select("user_id", "place", "start", "end", "n")


@query("""WITH e AS (SELECT o_orderkey id, unnest(['Segment > ' || c_mktsegment, 'Timeline > ' || year(o_orderdate), 'Segment > Priority > ' || o_orderpriority]) path FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'browse' AS way, 'Segment > Priority' AS key, count(DISTINCT id) n FROM e WHERE path LIKE 'Segment > Priority > %' UNION ALL SELECT 'timeline', '1996', count(*) FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT 'timeline', '1997-12', count(*) FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 12
UNION ALL SELECT 'intent', 'brass steel', count(*) FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'brass') AND list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'steel') UNION ALL SELECT 'relations', path, count(DISTINCT id) FROM e WHERE id IN (SELECT id FROM e WHERE path = 'Timeline > 1995') AND path <> 'Timeline > 1995' GROUP BY path""")
def retrieval_ways(spark, t):
    from ledgerline.plans.registry import _order_entries

    index, orders = _order_entries(t), t("orders")
    counted = lambda df, way, key: df.agg(F.count("*").alias("n")).select(F.lit(way).alias("way"), F.lit(key).alias("key"), "n")
    found = counted(memory.browse(index, "Segment > Priority").select("o_orderkey").distinct(), "browse", "Segment > Priority")
    found = found.union(counted(memory.timeline(orders, "o_orderdate", 1996), "timeline", "1996")).union(counted(memory.timeline(orders, "o_orderdate", 1997, 12), "timeline", "1997-12"))
    found = found.union(counted(memory.intent(t("part"), "p_name", ["Brass", "steel"]), "intent", "brass steel"))
    return found.union(memory.relations(index, "o_orderkey", "Timeline > 1995").select(F.lit("relations").alias("way"), F.col("path").alias("key"), "n"))


_CLASSES = "SELECT doc_id, 'q' || quality truth, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars > 300 THEN 'q1' ELSE 'q0' END predicted, (n_chars % 10) / 10.0::DOUBLE conf, CASE WHEN n_chars > 200 THEN 'q1' END a, CASE WHEN lang = 'en' THEN 'q1' ELSE 'q0' END b, CASE WHEN doc_id % 2 = 0 THEN 'q0' END c FROM labels JOIN documents USING (doc_id)"


def _classified(t):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars", "lang"), "doc_id")
    n = F.col("n_chars")
    return rows.select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("truth"), F.when(n % 5 == 0, None).when(n > 300, "q1").otherwise("q0").alias("predicted"), ((n % 10) / 10.0).alias("confidence"),
        F.when(n > 200, "q1").alias("a"), F.when(F.col("lang") == "en", "q1").otherwise("q0").alias("b"), F.when(F.col("doc_id") % 2 == 0, "q0").alias("c"),
    )


@query(f"""SELECT truth, coalesce(predicted, 'unknown') AS predicted, count(*) n FROM ({_CLASSES}) GROUP BY 1, 2""")
def confusion_matrix(spark, t):
    return memory.confusion(_classified(t), "truth", "predicted")


@query(f"""WITH x AS ({_CLASSES}), k AS (SELECT DISTINCT truth cls FROM x UNION SELECT DISTINCT coalesce(predicted, 'unknown') FROM x), s AS (SELECT cls, (SELECT count(*) FROM x WHERE truth = cls) t, (SELECT count(*) FROM x WHERE coalesce(predicted, 'unknown') = cls) p, (SELECT count(*) FROM x WHERE truth = cls AND predicted = cls) h FROM k)
SELECT cls AS "class", t AS support, round(coalesce(h / nullif(p, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(h / nullif(t, 0)::DOUBLE, 0), 6) AS recall FROM s""")
def class_report(spark, t):
    return memory.class_report(_classified(t), "truth", "predicted").withColumns({"precision": r("precision"), "recall": r("recall")})


@query(f"""SELECT count(*) n, round(avg((predicted IS NOT NULL AND conf >= 0.4)::INT), 6) AS coverage, round(1 - avg((predicted IS NOT NULL AND conf >= 0.4)::INT), 6) AS unknown_ratio FROM ({_CLASSES})""")
def class_coverage(spark, t):
    return memory.coverage(_classified(t), "predicted", "confidence", 0.4).withColumns({"coverage": r("coverage"), "unknown_ratio": r("unknown_ratio")})


@query(f"""WITH x AS ({_CLASSES}), v AS (SELECT *, list_filter([a, b, c], lambda z: z IS NOT NULL) l FROM x), w AS (SELECT *, len(list_filter(l, lambda z: z = 'q1')) n1, len(list_filter(l, lambda z: z = 'q0')) n0 FROM v), y AS (SELECT *, CASE WHEN n1 > n0 THEN 'q1' WHEN n0 > n1 THEN 'q0' ELSE l[1] END m FROM w)
SELECT s AS signals, count(*) n, round(avg(coalesce((CASE s WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c ELSE m END) = truth, false)::INT), 6) AS accuracy FROM y, (VALUES ('a'), ('b'), ('c'), ('a+b+c')) q(s) GROUP BY 1""")
def signal_ablation(spark, t):
    return memory.ablation(_classified(t), "truth", ["a", "b", "c"]).withColumn("accuracy", r("accuracy"))


@query("""WITH c AS (SELECT l_partkey t, l_suppkey r, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) / 2) b FROM c), t AS (SELECT sum(n * (n - 1) / 2) t FROM (SELECT sum(n) n FROM c GROUP BY c.t)), m AS (SELECT sum(n * (n - 1) / 2) m FROM (SELECT sum(n) n FROM c GROUP BY c.r))
SELECT t AS "true", m AS made, b AS both, round(b / m, 8) AS "precision", round(b / t, 8) AS recall, round(2 * (b / m) * (b / t) / (b / m + b / t), 8) AS f1, m - b AS false_merges, t - b AS false_splits FROM b, t, m""")
def entity_report(spark, t):
    got = memory.entity_report(t("lineitem"), "l_partkey", "l_suppkey")
    return got.withColumns({c: r(c, 8) for c in ("precision", "recall", "f1")})


@query("""SELECT user_id, max(value) AS peak, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS mean FROM events GROUP BY 1 HAVING mean IS NOT NULL UNION ALL SELECT user_id, max(value), 0 FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') = 0""")
def sample_peaks(spark, t):
    rows = t("events").withColumn("cpu", F.when(F.col("event_type") == "view", F.col("value")))
    return memory.samples_summary(rows, ["user_id"], "value", "cpu").withColumn("mean", r("mean"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT END AS created_at, CASE WHEN event_id % 5 <> 0 THEN value END AS lat, CASE WHEN event_id % 7 <> 0 THEN value / 2 END AS lon, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND value IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS loc_confidence FROM events""")
def asset_metadata(spark, t):
    k = F.col("event_id")
    rows = t("events").select("event_id", F.when(k % 6 != 0, F.col("ts").cast("timestamp")).alias("at"), F.when(k % 5 != 0, F.col("value")).alias("y"), F.when(k % 7 != 0, F.col("value") / 2).alias("x"))
    return rows.select("event_id", *(c.alias(n) for n, c in signals.metadata(F.col("at"), F.col("y"), F.col("x")).items()))


@query("""SELECT p_partkey, replace(replace(left('<' || p_name || '> & "' || p_type || '"', 34), '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('"', '&quot;') AS label FROM part""")
def labels_escaped(spark, t):
    said = F.concat(F.lit("<"), F.col("p_name"), F.lit('> & "'), F.col("p_type"), F.lit('"'))
    return t("part").select("p_partkey", text.label(said).alias("label"))


@query("""SELECT n_nationkey, 'docs/n' || n_nationkey || '.md' AS links, 'f' || n_nationkey || '.py,' || n_name || '.csv' AS files, 'About ' || n_name || chr(10) AS section, n_nationkey % 2 = 0 AS answered FROM nation""")
def references(spark, t):
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    doc = F.concat(F.lit("# Top\nsee [a](docs/n"), k, F.lit(".md#part) and [w](https://x.y/z) or [m](mailto:a@b)\nfiles `f"), k, F.lit(".py`, `*.md`, `x.exe` and `"), name, F.lit(".csv`\n## About it\nAbout "), name, F.lit("\n## Last\n"), F.when(F.col("n_nationkey") % 2 == 0, "owner and date").otherwise("owner"))
    from ledgerline.operators.quality import answerable

    return t("nation").select("n_nationkey", doc.alias("d")).select("n_nationkey", F.array_join(text.links(F.col("d")), ",").alias("links"), F.array_join(text.file_references(F.col("d")), ",").alias("files"), text.section(F.col("d"), "About it").alias("section"), answerable(F.col("d"), ["own.r", "date"]).alias("answered"))
