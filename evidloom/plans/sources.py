"""Queries SRC1 to SRC24 and SNK1 to SNK8: round trips through the formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graphs import checkpoint_folder
from ..registry import query
from ..sources import readers as R
from ..sources import writers as W
from ..sources import zips as Z
from .fixtures import table


def folder(spark, name):
    """A new folder below the shared one for this run's files."""
    return f"{checkpoint_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def customer_csv(spark, d):
    W.csv(table(spark, d, "customer"), path := folder(spark, "csv"))
    return path


@query("SRC1_csv_scan", "SELECT * FROM customer")
def src1(spark, d):
    return R.csv(spark, customer_csv(spark, d), CUSTOMER)


@query("SRC2_csv_pruned", "SELECT c_custkey, c_mktsegment FROM customer")
def src2(spark, d):
    return R.csv(spark, customer_csv(spark, d), CUSTOMER, ["c_custkey", "c_mktsegment"])


@query("SRC3_csv_all_strings", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS n_name FROM nation")
def src3(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name"))
    W.csv(n, path := folder(spark, "strings"))
    return R.all_strings(spark, path, ["n_nationkey", "n_name"])


@query("SRC4_tsv_with_comments", "SELECT s_suppkey, s_name FROM supplier")
def src4(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_name")
    head = spark.createDataFrame([("#s_suppkey\ts_name",)], "value string")
    head.unionByName(s.select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name").alias("value"))).write.text(path := folder(spark, "tsv"))
    return R.tsv(spark, path, "s_suppkey long, s_name string")


@query("SRC5_piped_scan_filtered", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#3'")
def src5(spark, d):
    table(spark, d, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("value")).write.text(path := folder(spark, "piped"))
    return R.piped(spark, path, "p_partkey long, p_name string, p_brand string").where("p_brand = 'Brand#3'").select("p_partkey", "p_name")


LINES = ["l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity"]


def line_zips(spark, d, **options):
    """Zip files of several members each, one file a partition of `lineitem`."""
    path = folder(spark, "zips")
    Z.write_zips(table(spark, d, "lineitem", *LINES), path, rows_of_member=20_000, **options)
    return path


@query("SRC6_zipped_csv_counts", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1")
def src6(spark, d):
    return Z.zip_table(spark, line_zips(spark, d), "l_returnflag string, l_linenumber long").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("SRC7_zip_member_columns", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_returnflag FROM lineitem")
def src7(spark, d):
    return Z.zip_table(spark, line_zips(spark, d), "l_orderkey long, l_returnflag string")


@query("SRC8_gzip_csv", "SELECT c_custkey, c_acctbal FROM customer")
def src8(spark, d):
    table(spark, d, "customer").write.options(header=True, compression="gzip").csv(path := folder(spark, "gz"))
    return R.csv(spark, path, CUSTOMER, ["c_custkey", "c_acctbal"])


@query("SRC9_keyed_line_filter", "SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_returnflag AS flag FROM lineitem WHERE l_orderkey < 7 OR l_suppkey < 7")
def src9(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag")
    li.select(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.lit("x"), "l_returnflag", F.lit(""), F.col("l_suppkey").cast("string")).alias("value")).write.text(path := folder(spark, "lines"))
    keys = spark.range(7).select(F.col("id").cast("string").alias("id"))
    return R.keyed_lines(spark, path, keys, "id", {"a": 0, "b": 4, "flag": 2})


@query("SRC9_keyed_zip_members", "SELECT CAST(l_orderkey AS VARCHAR) AS a, l_returnflag AS flag, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem WHERE l_orderkey < 7 OR l_suppkey < 7")
def src9_zip(spark, d):
    """Members without a header, delimited by bars, of which rows with one of two keys leave the reader."""
    keys = [str(k) for k in range(7)]
    path = line_zips(spark, d, header=False, delimiter="|")
    return Z.zip_table(spark, path, "a string, flag string, b string", delimiter="|", names=["a", "line", "flag", "b", "quantity"], keys={"a": keys, "b": keys})


@query("SRC10_block_decision", "SELECT p_brand, CASE WHEN count(*) FILTER (p_type = 'PROMO') > 0 THEN min(p_name) FILTER (p_type = 'PROMO') ELSE min(p_name) END AS chosen FROM part GROUP BY 1")
def src10(spark, d):
    promo = F.min(F.when(F.col("p_type") == "PROMO", F.col("p_name")))
    return table(spark, d, "part", "p_brand", "p_type", "p_name").groupBy("p_brand").agg(F.coalesce(promo, F.min("p_name")).alias("chosen"))


@query("SRC11_parquet_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def src11(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_quantity")


@query("SRC12_parquet_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (1, 2, 3, 500, 900) OR o_totalprice > 490000")
def src12(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    return o.where(((F.col("o_orderpriority") == "1-URGENT") & F.col("o_orderkey").isin(1, 2, 3, 500, 900)) | (F.col("o_totalprice") > 490000)).select("o_orderkey", "o_totalprice")


@query("SRC13_distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")
def src13(spark, d):
    return R.csv(spark, customer_csv(spark, d), CUSTOMER, ["c_mktsegment"]).distinct()


CATALOG = '{"E_1": {"name": "E_1", "question_en": "Pain?", "data_type": "B", "code_question": "E_1", "is_antecedent": false, "possible_values": []}, "E_2": {"name": "E_2", "question_en": "Where?", "data_type": "M", "code_question": "E_1", "is_antecedent": false, "possible_values": ["V_1", "V_2"]}, "E_134": {"name": "E_134", "question_en": "?", "data_type": "C", "code_question": "E_134", "is_antecedent": true, "possible_values": ["0"]}}'


@query("SRC14_json_catalog", "SELECT * FROM (VALUES ('E_1', 'Pain?', 'B', NULL, 0), ('E_2', 'Where?', 'M', 'E_1', 2)) v(code, question_en, data_type, parent, n_values)")
def src14(spark, d):
    spark.createDataFrame([(CATALOG,)], "value string").coalesce(1).write.text(path := folder(spark, "json"))
    return R.catalog(spark, path, ["E_134", "E_152"]).select("code", "question_en", "data_type", "parent", F.size("possible_values").alias("n_values"))


@query("SRC15_json_lines", "SELECT s_suppkey, s_name FROM supplier")
def src15(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_name")
    s.unionByName(s.limit(5)).write.json(path := folder(spark, "jsonl"))
    return R.json_lines(spark, path, "s_suppkey long, s_name string", "s_suppkey")


@query("SRC16_nested_documents", "SELECT 'D' || r_regionkey AS name, s AS section, r_name AS item FROM region CROSS JOIN (VALUES ('phenotypes'), ('environmental')) v(s)")
def src16(spark, d):
    text = F.concat(F.lit("name: D"), F.col("r_regionkey"), F.lit("\nphenotypes:\n  - name: "), F.col("r_name"), F.lit("\nenvironmental:\n  - name: "), F.col("r_name"))
    table(spark, d, "region").select(text.alias("value")).repartition(5, "value").write.option("maxRecordsPerFile", 1).text(path := folder(spark, "yaml"))
    return R.yaml_phenotypes(spark, path)


@query("SRC17_obo_stanzas", "SELECT 'T:' || n_nationkey AS id, n_name AS name, 1 + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS n_parents, n_nationkey % 5 = 0 AS obsolete FROM nation")
def src17(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(F.lit("[Term]\nid: T:"), k, F.lit("\nname: "), F.col("n_name"), F.lit('\nsynonym: "x" EXACT []\nis_a: T:0 ! root'), F.when(k % 2 == 0, "\nis_a: T:1 ! one").otherwise(""), F.when(k % 5 == 0, "\nis_obsolete: true").otherwise(""), F.lit("\n"))
    table(spark, d, "nation").select(text.alias("value")).write.text(path := folder(spark, "obo"))
    return R.stanzas(spark, path).select("id", "name", F.size("parents").alias("n_parents"), "obsolete")


@query("SRC18_release_tables", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS \"typeId\" FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def src18(spark, d):
    c = table(spark, d, "customer")
    c.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), (F.col("c_custkey") % 2).cast("string"), "c_mktsegment").alias("value")).write.text(path := folder(spark, "rf2"))
    return R.active_rows(R.tsv(spark, path, "id string, active string, typeId string"), ["BUILDING", "MACHINERY"]).select("id", "typeId")


@query("SRC19_tagged_corpus", "SELECT CAST(len(string_split(text, ' ')) AS INT) AS n, count(*) AS docs FROM benchmark WHERE NOT contains(text, chr(10)) AND NOT contains(text, '  ') GROUP BY 1")
def src19(spark, d):
    b = table(spark, d, "benchmark", "text").where("not contains(text, '\n') and not contains(text, '  ')")
    lines = F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit("\tO")))
    b.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")).write.text(path := folder(spark, "bio"))
    return R.tagged_corpus(spark, path).groupBy(F.size("tokens").alias("n")).agg(F.count("*").alias("docs"))


@query("SRC20_long_dense_table", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, embedding[i] AS v FROM embeddings CROSS JOIN range(1, 65) r(i) WHERE vec_id < 50")
def src20(spark, d, keep="vec_id < 50"):
    return table(spark, d, "embeddings", "vec_id", "embedding").where(keep).select("vec_id", F.posexplode("embedding").alias("pos", "v"))


@query("SRC21_batched_point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)")
def src21(spark, d):
    keys = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("p_partkey"))
    return table(spark, d, "part", "p_partkey", "p_name").join(keys, "p_partkey", "left_semi")


@query("SRC22_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def src22(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("SRC24_stamped_cache", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def src24(spark, d):
    """A table's totals, kept under the names, sizes and times of its files."""
    build = lambda t: t.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return R.stamped(spark, f"{d}/customer.parquet", f"{checkpoint_folder(spark)}/files/stamped/customer-{uuid.uuid5(uuid.NAMESPACE_URL, d).hex}", build)


@query("SNK1_csv_sink", "SELECT n_nationkey, n_name FROM nation")
def snk1(spark, d):
    W.csv(table(spark, d, "nation", "n_nationkey", "n_name"), path := folder(spark, "out"), one_file=True)
    return R.csv(spark, path, "n_nationkey int, n_name string")


@query("SNK2_csv_empty_marker", "SELECT 'EMPTY' AS status")
def snk2(spark, d):
    W.csv_or_empty(table(spark, d, "nation").where("n_nationkey < 0"), path := folder(spark, "empty"))
    return R.csv(spark, path, "status string")


@query("SNK3_parquet_sink", "SELECT * FROM supplier")
def snk3(spark, d):
    W.parquet(table(spark, d, "supplier"), path := folder(spark, "parquet"))
    return spark.read.parquet(path)


@query("SNK4_chunked_parquet", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk4(spark, d):
    W.parquet(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), path := folder(spark, "chunks"), rows_per_file=5000, by=["o_orderpriority"])
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SNK5_json_summary", "SELECT '{\"n\":' || count(*) || ',\"segment\":\"' || c_mktsegment || '\"}' AS value FROM customer GROUP BY c_mktsegment")
def snk5(spark, d):
    W.json_summary(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), path := folder(spark, "summary"))
    return spark.read.text(path)


@query("SNK6_bucketed_index", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def snk6(spark, d):
    tag = uuid.uuid4().hex[:12]
    W.index(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), f"line_{tag}", ["l_orderkey"], 8)
    W.index(table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey"), f"order_{tag}", ["l_orderkey"], 8)
    return spark.table(f"line_{tag}").join(spark.table(f"order_{tag}"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SNK7_sealed_outputs", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'sealed' ELSE 'public' END AS part, count(*) AS n FROM orders GROUP BY 1")
def snk7(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return W.sealed(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), folder(spark, "sealed")).select("part", "n")


@query("SNK8_append_log", "SELECT 'START' AS event, 1 AS step UNION ALL SELECT 'DONE', 2")
def snk8(spark, d):
    path = folder(spark, "log")
    for step, event in enumerate(("START", "DONE"), 1):
        W.append_log(spark.createDataFrame([(event, step)], "event string, step int"), path)
    return spark.read.schema("event string, step int").parquet(path)
