"""Sources and sinks: tables written, read back and checked; keyed tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import coerce
from ledgerline.operators import funnel, hierarchy, incremental, quality
from ledgerline.plans.base import query, r
from ledgerline.sources import files
from ledgerline.storage import fresh


def _quoted(t):
    part = t("part")
    return part.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"')).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "line\nbreak").otherwise("plain").alias("note"), files.fixed("p_retailprice"))


@query("""SELECT p_partkey::VARCHAR AS id, p_name || ', "' || p_brand || '"' AS name, CASE WHEN p_partkey % 3 = 0 THEN 'line' || chr(10) || 'break' ELSE 'plain' END AS note, printf('%.3f', p_retailprice) AS p_retailprice FROM part""")
def csv_round_trip(spark, t):
    path, names = fresh(spark, "csv"), ["id", "name", "note", "p_retailprice"]
    files.append_csv(_quoted(t).filter("id % 2 = 0"), path, names)
    files.append_csv(_quoted(t).filter("id % 2 = 1"), path, names)
    return files.read_csv(spark, path, names)


@query("""SELECT * FROM (VALUES ('ram_gb', 'missing'), ('ramgb', 'unexpected')) v("column", side)""")
def header_gate(spark, t):
    names = lambda n: spark.createDataFrame([(x,) for x in n], "column string")
    return quality.header_differences(names(["chip", "ramgb"]), names(["chip", "ram_gb"]))


@query("""SELECT 'iPhone' || s_suppkey AS device_model, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 0""")
def shifted_rows(spark, t):
    rows = t("supplier").select(F.concat(F.lit("iPhone"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(",1")).alias("device_model"), F.col("s_suppkey").alias("k"))
    return quality.shifted(rows, "device_model", "iphone")


@query("""SELECT s_suppkey || ',x' AS value, 2::INT AS cells FROM supplier WHERE s_suppkey % 5 = 0""")
def short_lines(spark, t):
    path = fresh(spark, "lines")
    k = F.col("s_suppkey").cast("string")
    t("supplier").select(F.when(F.col("s_suppkey") % 5 == 0, F.concat(k, F.lit(",x"))).otherwise(F.concat(k, F.lit(',"a,b",c'))).alias("value")).write.text(path)
    return files.wrong_width(spark, path, 3)


@query("""SELECT 'a' AS m, 'iPhone14,5' AS n UNION ALL SELECT 'b', NULL""")
def csv_in_memory(spark, t):
    return files.csv_rows(spark, 'm,n\na,"iPhone14,5"\nb\n')


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0""")
def json_lines(spark, t):
    path = fresh(spark, "jsonl")
    good = t("orders").select("o_orderkey", "o_orderstatus")
    files.append_lines(good.filter("o_orderkey % 5 <> 0"), path)
    good.filter("o_orderkey % 5 = 0").select(F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "o_order')).alias("value")).write.mode("append").text(path)
    return files.read_lines(spark, path, "o_orderkey long, o_orderstatus string")


@query("""SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_documents(spark, t):
    path = fresh(spark, "json")
    nations = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    files.write_document(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(nations.alias("nations")), path)
    got = spark.read.json(path).select("r_name", F.explode("nations").alias("n"))
    return got.select("n.n_nationkey", "n.n_name", "r_name").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("""SELECT 'region' || r_regionkey AS name, r_name || chr(10) AS value FROM region""")
def whole_texts(spark, t):
    path = fresh(spark, "texts")
    t("region").select(F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("value")).repartition(1).write.partitionBy("name").text(path)
    return files.read_whole(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "value")


@query("""SELECT 'data' AS kind, 5::BIGINT AS files, sum(length(r_name) + 1)::BIGINT AS bytes FROM region""")
def file_sizes(spark, t):
    path = fresh(spark, "index")
    t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("value")).repartition(1).write.partitionBy("name").text(f"{path}/kept")
    t("region").select(F.col("r_name").alias("value")).coalesce(1).write.text(f"{path}/.git")
    index = files.file_index(spark, path).filter(F.col("name").endswith(".txt"))
    return index.agg(F.sum(F.size("paths")).alias("files"), F.sum("bytes").alias("bytes")).select(F.lit("data").alias("kind"), "files", "bytes")


@query("""SELECT 'app' || s_suppkey % 12 AS app, 'Plan ' || s_suppkey AS label, CASE WHEN s_suppkey % 9 <> 0 THEN (1000 + s_suppkey)::DOUBLE + 0.5 END AS price FROM supplier""")
def price_pairs(spark, t):
    path = fresh(spark, "pairs")
    k = F.col("s_suppkey")
    pair = F.when(k % 9 != 0, F.array(F.concat(F.lit("Plan "), k.cast("string")), F.concat(F.lit("$"), F.format_number(1000.5 + k, 2)))).otherwise(F.array(F.concat(F.lit("Plan "), k.cast("string"))))
    apps = t("supplier").groupBy(F.concat(F.lit("app"), (k % 12).cast("string")).alias("app")).agg(F.collect_list(pair).alias("plans"))
    apps.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("app", "plans")))).alias("value")).coalesce(1).write.text(path)  # twelve apps
    return files.read_pairs(spark, path).withColumn("price", F.col("price").cast("double"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 400 ELSE 204 END status FROM events) SELECT status, count(*) n, sum(event_id)::BIGINT AS ids FROM x GROUP BY 1""")
def event_ingest(spark, t):
    requests, _ = files.land(_requests(t))
    return requests.groupBy("status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("status", F.col("status").cast("int"))


@query("""SELECT event_id, 'a' || user_id % 3 AS arm, CASE WHEN event_id % 5 <> 2 THEN 's' || user_id END AS sid, event_type AS event FROM events WHERE event_id % 5 > 1""")
def ingested_events(spark, t):
    return files.land(_requests(t))[1].select("event_id", "arm", "sid", "event")


def _requests(t):
    k, user = F.col("event_id") % 5, F.col("user_id")
    body = F.to_json(F.struct(F.concat(F.lit("a"), (user % 3).cast("string")).alias("arm"), F.when(k != 2, F.concat(F.lit("s"), user.cast("string"))).alias("sid"), F.col("event_type").alias("event")))
    return t("events").select("event_id", F.lit("POST").alias("method"), F.when(k == 0, "/other").otherwise("/event").alias("path"), F.when(k == 1, F.lit("{broken")).otherwise(body).alias("body"))


@query("""SELECT count(*) n, count(*) FILTER (coalesce(trim(CASE event_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE event_type END), '') = '') AS blank FROM events""")
def blank_texts(spark, t):
    k = F.col("event_id") % 4
    rows = t("events").select(F.when(k == 0, "  ").when(k == 1, None).otherwise(F.col("event_type")).alias("x"))
    return rows.agg(F.count("*").alias("n"), F.count_if(coerce.blank("x")).alias("blank"))


@query("""SELECT event_id % 2 = 0 AS captured, count(*) n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def private_split(spark, t):
    rows = t("events").select("user_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.y"))).alias("email"))
    public, _ = funnel.split_private(rows, "email")
    return public.groupBy("captured").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT p_brand AS route, p_type AS category, count(*) n FROM part GROUP BY 1, 2""")
def worksheet(spark, t):
    checks = quality.constraints(t("part"), {"priced": (F.col("p_retailprice") > 0, F.count("*")), "sized": (F.col("p_size") > 0, F.count("*"))})
    rows = t("part").groupBy(F.col("p_brand").alias("route"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"))
    path = fresh(spark, "worksheet")
    quality.gated(rows.orderBy("route", F.desc("n"), "category"), checks).write.option("header", True).csv(path)
    return files.read_csv(spark, path).select("route", "category", F.col("n").cast("long").alias("n"))


@query("""SELECT lang AS slug, count(*) AS n FROM documents GROUP BY 1""")
def page_sink(spark, t):
    docs = t("documents").select(F.col("lang").alias("path"), "doc_id", "n_chars")
    path = fresh(spark, "pages")
    hierarchy.write_pages(hierarchy.page_html(hierarchy.leaf_view(docs, [F.desc("n_chars"), F.asc("doc_id")]), "doc_id"), path)
    written = spark.read.text(path).select("slug", F.regexp_count("value", F.lit("<li>")).alias("shown"), F.coalesce(F.regexp_extract("value", r"<p>(\d+) more", 1).try_cast("long"), F.lit(0)).alias("more"))
    return written.select("slug", (F.col("shown") + F.col("more")).cast("long").alias("n"))


@query("""WITH c AS (SELECT o_custkey k, o_orderkey % 1000 seq, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'delete' ELSE 'update' END op FROM orders), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC, op, o_orderkey DESC) = 1) SELECT k, seq FROM l WHERE op <> 'delete'""")
def keyed_store(spark, t):
    from ledgerline.streaming.merge import KeyedTable

    path = fresh(spark, "store")
    k = F.col("o_orderkey")
    changes = t("orders").select(F.col("o_custkey").alias("k"), (k % 1000).alias("seq"), F.when(k % 9 == 0, "delete").otherwise("update").alias("op"))
    for number, part in enumerate([2, 0, 1]):  # later changes first; every batch through a table opened anew
        KeyedTable(spark, path, "k", ["seq"]).merge(changes.filter(F.pmod(F.col("seq"), F.lit(3)) == part), number)
    KeyedTable(spark, path, "k", ["seq"]).merge(changes.limit(10), 1)  # an old batch again
    return KeyedTable(spark, path, "k", ["seq"]).read().select("k", "seq")


@query("""SELECT user_id, event_type, count(*) n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) rn FROM events) WHERE rn = 1 OR event_type = 'purchase' GROUP BY 1, 2""")
def stream_dedup(spark, t):
    from ledgerline.streaming.funnel import deduplicated, read_stream, run_once

    stream = read_stream(spark, t("events")).withColumn("at", F.col("ts").cast("timestamp"))
    kept = deduplicated(stream, ["user_id", "event_type"], "at", F.col("event_type") == "purchase", late="36500 days")
    return run_once(kept, "dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT floor((row_number() OVER (ORDER BY event_id) - 1) / 50)::BIGINT AS batch, event_id, event_type, round(value, 6) AS value FROM events""")
def insert_batches(spark, t):
    return incremental.batch_numbers(t("events").select("event_id", "event_type", "value"), "event_id", 50).withColumn("value", r("value"))


@query("""SELECT '{"count":' || count(*) || ',"first":' || min(o_orderkey) || '}' AS probe FROM orders""")
def probe_json(spark, t):
    path = fresh(spark, "probe")
    files.write_document(t("orders").agg(F.count("*").alias("count"), F.min("o_orderkey").alias("first")).coalesce(1), path)
    return files.read_document(spark, path).select(F.to_json(F.struct("count", "first")).alias("probe"))


@query("""SELECT n_regionkey AS app, json_object('id', n_regionkey, 'n', count(*))::VARCHAR AS record FROM nation GROUP BY 1""")
def evidence_records(spark, t):
    path = fresh(spark, "evidence")
    files.write_document(t("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.count("*").alias("n")), path)
    got = spark.read.schema("id int, n long").json(path)
    return got.select(F.col("id").alias("app"), F.to_json(F.struct("id", "n")).alias("record"))
