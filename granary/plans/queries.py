"""The registered queries over the driver's tables, each with the DuckDB SQL that it is compared with.

Stand-ins: an order is an image, a line item an instance, its return flag the class, ten times its discount the
confidence; event values are latencies; document texts are file contents and label files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import geometry, text
from granary.operators import audit, balance, components, counts, dedupe, detections, distance, latency, masks, samples, skeleton, split
from granary.shared import parts
from granary.sources import labels, reports

CLASSES = ["A", "N", "R"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").withColumn("conf", F.col("l_discount") * 10)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.with_errors(counts.count_grid(*_counted(spark, sf_dir), "image", "class_name", CLASSES, F.col("l_discount") >= 0.03))


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    images = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"))
    return images, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("class_name"), "l_discount")


_GRID = """WITH cell AS (SELECT l_orderkey AS image, l_returnflag AS class_name, count(*) AS gt, count(*) FILTER (l_discount >= 0.03) AS pred FROM lineitem GROUP BY 1, 2),
grid AS (SELECT o_orderkey AS image, c AS class_name FROM orders, (VALUES ('A'), ('N'), ('R')) v(c)),
counted AS (SELECT grid.image, grid.class_name, coalesce(gt, 0) AS gt_count, coalesce(pred, 0) AS pred_count FROM grid LEFT JOIN cell USING (image, class_name)),
errors AS (SELECT *, pred_count - gt_count AS error, abs(pred_count - gt_count) AS abs_error, (pred_count - gt_count) * (pred_count - gt_count) AS squared_error, pred_count = gt_count AS exact FROM counted),
totals AS (SELECT image, sum(gt_count)::BIGINT AS gt_count, sum(pred_count)::BIGINT AS pred_count FROM counted GROUP BY image),
total_errors AS (SELECT *, pred_count - gt_count AS error, abs(pred_count - gt_count) AS abs_error, (pred_count - gt_count) * (pred_count - gt_count) AS squared_error, pred_count = gt_count AS exact FROM totals)
"""
_METRIC = "count(*) AS samples, sum(gt_count)::BIGINT AS gt_total, sum(pred_count)::BIGINT AS pred_total, round(avg(abs_error), 6) AS mae, round(sqrt(avg(squared_error)), 6) AS rmse, round(avg(exact::INT), 6) AS exact_accuracy"


@_query(f"{_GRID} SELECT class_name, {_METRIC} FROM errors GROUP BY class_name")
def count_error_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_metric(_errors(spark, sf_dir), "class_name")


@_query(f"{_GRID} SELECT {_METRIC} FROM errors")
def count_error_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_metric(_errors(spark, sf_dir))


@_query(f"{_GRID} SELECT {_METRIC} FROM total_errors")
def count_error_image_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_metric(counts.image_totals(_errors(spark, sf_dir), "image"))


@_query(f"{_GRID} SELECT 'class' AS row_type, image, class_name, gt_count, pred_count, error, abs_error, squared_error, exact FROM errors UNION ALL SELECT 'total', image, 'overall', gt_count, pred_count, error, abs_error, squared_error, exact FROM total_errors")
def count_errors_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counts.count_rows(*_counted(spark, sf_dir), "image", "class_name", CLASSES, F.col("l_discount") >= 0.03)
    return rows.select("row_type", "image", "class_name", "gt_count", "pred_count", "error", "abs_error", "squared_error", "exact")


_EVAL = """WITH g AS (SELECT o_orderkey AS image, id AS class_id, count(*) FILTER (l_tax < 0.06) AS gt_count, count(*) FILTER (l_discount >= 0.03) AS pred_count
FROM orders CROSS JOIN (VALUES (0, 'A'), (1, 'N'), (2, 'R')) c(id, flag) LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = flag GROUP BY ALL),
t AS (SELECT image, -1 AS class_id, sum(gt_count)::BIGINT AS gt_count, sum(pred_count)::BIGINT AS pred_count FROM g GROUP BY image),
e AS (SELECT *, pred_count - gt_count AS error FROM (SELECT 'by_class' AS part, class_id AS shown, * FROM g UNION ALL SELECT 'overall', NULL, * FROM g UNION ALL SELECT 'per_image_total', NULL, * FROM t)),
m AS (SELECT part, shown AS class_id, MAP {'samples': count(*)::DOUBLE, 'gt_total': sum(gt_count)::DOUBLE, 'pred_total': sum(pred_count)::DOUBLE, 'mae': avg(abs(error)), 'rmse': sqrt(avg(error * error)), 'exact_count_accuracy': avg((error = 0)::INT)} AS v FROM e GROUP BY ALL),
l AS (SELECT 'latency.inference' AS part, o_custkey % 97 + 0.5 AS ms FROM orders UNION ALL SELECT 'latency.end_to_end', o_custkey % 97 + 1.5 + o_orderkey % 7 FROM orders),
n AS (SELECT part, NULL::INT AS class_id, MAP {'count': count(*)::DOUBLE, 'mean_ms': avg(ms::DOUBLE), 'median_ms': quantile_cont(ms::DOUBLE, 0.5), 'p95_ms': quantile_cont(ms::DOUBLE, 0.95)} AS v FROM l GROUP BY part)
SELECT part, class_id, metric, round(v[metric], 6) AS value FROM m, (SELECT unnest(['samples', 'gt_total', 'pred_total', 'mae', 'rmse', 'exact_count_accuracy']) AS metric)
UNION ALL SELECT part, class_id, metric, round(v[metric], 6) FROM n, (SELECT unnest(['count', 'mean_ms', 'median_ms', 'p95_ms']) AS metric)"""


@_query(_EVAL)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("image"), F.col("o_orderkey").alias("image_path"), (F.col("o_custkey") % 97 + 0.5).alias("inference_ms"), (F.col("o_custkey") % 97 + 1.5 + F.col("o_orderkey") % 7).alias("end_to_end_ms"))
    found = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_path"), (F.ascii("l_returnflag") - 65).alias("flag"), "l_tax", "l_discount")
    found = found.withColumn("class_id", F.when(F.col("flag") == 0, 0).when(F.col("flag") == 13, 1).when(F.col("flag") == 17, 2))
    rows = counts.evaluation_rows(images, found, {0: "A", 1: "N", 2: "R"}, F.col("l_discount") >= 0.03, F.col("l_tax") < 0.06)
    return counts.evaluation_metrics(rows).withColumn("value", F.round("value", 6))


@_query("SELECT event_id AS document, key AS path, NULL::VARCHAR AS parent, key AS metric, TRY_CAST(props ->> key AS DOUBLE) AS value, props ->> key AS text, false AS corrupt FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def metrics_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metric_rows(_t(spark, sf_dir, "events"), "event_id", "props")


@_query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.summary(_t(spark, sf_dir, "events"), "value", "event_type")


@_query("""SELECT event_id, user_id, round(avg(value) OVER w, 6) AS rolling_mean, CASE WHEN count(value) OVER w >= 5 THEN round(quantile_cont(value, 0.95) OVER w, 6) END AS rolling_p95
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.rolling(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "rolling_mean", "rolling_p95")


@_query("""SELECT event_id, round(avg(value) OVER w, 6) AS rolling_mean, CASE WHEN count(value) OVER w >= 5 THEN round(quantile_cont(value, 0.95) OVER w, 6) END AS rolling_p95
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_latency_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.rolling(_t(spark, sf_dir, "events").select("event_id", "ts", "value"), "value", [], ["ts", "event_id"]).select("event_id", "rolling_mean", "rolling_p95")


@_query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.summary(_t(spark, sf_dir, "events"), "value")


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_label_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@_query("SELECT DISTINCT l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").distinct()


@_query("SELECT l_linestatus, l_returnflag, count(*) AS instances, count(DISTINCT l_orderkey) AS images FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_returnflag))")
def dense_class_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.class_balance(_t(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_orderkey").select("l_linestatus", "l_returnflag", "instances", "images")


@_query("SELECT objects, count(*) AS images FROM (SELECT l_orderkey, count(*) AS objects FROM lineitem GROUP BY 1) GROUP BY objects")
def objects_per_image_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.objects_histogram(_t(spark, sf_dir, "lineitem"), "l_orderkey")


@_query("SELECT p_size, count(*) AS images FROM part GROUP BY p_size")
def size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.size_histogram(_t(spark, sf_dir, "part"), "p_size")


@_query("SELECT count(*) AS images, count(n) AS labelled, coalesce(sum(n), 0)::BIGINT AS instances, count(*) FILTER (n IS NULL) AS without FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha1("text").alias("digest"))


_RANKED = "(SELECT doc_id, source, sha1(text) AS digest, first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY source <> 'src0', doc_id) AS first FROM documents)"


@_query(f"SELECT doc_id, source, digest FROM {_RANKED} WHERE doc_id = first")
def exact_dedupe_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.kept(_hashed(spark, sf_dir), "digest", "source", "doc_id", "src0").select("doc_id", "source", "digest")


@_query(f"SELECT doc_id, first AS kept_path FROM {_RANKED} WHERE doc_id <> first")
def exact_dedupe_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dropped(_hashed(spark, sf_dir), "digest", "source", "doc_id", "src0")


@_query("""WITH r AS (SELECT c_custkey, c_mktsegment || '.jpg' AS name, sha1(c_name) AS digest, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.jpg$', '') || '_' || substr(digest, 1, 10) || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END || '.jpg' END AS output_name
FROM (SELECT *, row_number() OVER (PARTITION BY name, digest, n = 1 ORDER BY c_custkey) AS k FROM r)""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(".jpg")).alias("name"), F.sha1("c_name").alias("digest"))
    return dedupe.output_names(rows, "name", "digest", ["c_custkey"]).select("c_custkey", "output_name")


@_query("""SELECT o_orderkey, unnest(range(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 4 ELSE 1 END))::INT AS copy_no FROM orders""")
def balance_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return balance.oversample(_t(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_returnflag", ["R"])


@_query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount * 10 >= CASE WHEN l_returnflag = 'R' THEN 0.08 ELSE 0.25 END GROUP BY 1")
def per_class_conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where(detections.confident(F.col("conf"), F.col("l_returnflag"), {"R": 0.08}, 0.25))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@_query("SELECT l_returnflag, round(avg(l_discount * 10), 3) AS mean_conf, round(min(l_discount * 10), 3) AS min_conf, round(max(l_discount * 10), 3) AS max_conf FROM lineitem GROUP BY 1")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.confidence_stats(_lines(spark, sf_dir), "l_returnflag", "conf")


@_query("""WITH h AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_discount * 10 >= 0.25) AS has FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_returnflag, NOT has AS retried, count(*) AS n FROM lineitem JOIN h USING (l_orderkey) WHERE l_discount * 10 >= 0.25 OR (NOT has AND l_returnflag = 'R' AND l_discount * 10 >= 0.08) GROUP BY ALL""")
def low_conf_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections.low_confidence_retry(_lines(spark, sf_dir), "l_orderkey", "l_returnflag", "conf", "R", 0.25, 0.08)
    return rows.groupBy("l_orderkey", "l_returnflag", "retried").agg(F.count("*").alias("n"))


@_query("SELECT l_orderkey, l_returnflag, count(*) AS raw_count, count(*) FILTER (l_quantity >= 25) AS effective_count FROM lineitem GROUP BY 1, 2")
def effective_vs_raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.counts_raw_and_effective(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", 25)


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate"


@_query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', {_ORDER})::INT AS instance_id FROM lineitem WHERE l_returnflag <> 'N'")
def instance_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections.number_instances(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", _ORDER.split(", "), "R", ["N"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "instance_id")


@_query(f"SELECT l_orderkey, l_partkey, l_linenumber, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1) % 5)::INT AS colour FROM lineitem WHERE l_returnflag = 'N' AND l_quantity >= 20")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_quantity >= 20")
    return detections.palette_index(rows, "l_orderkey", _ORDER.split(", ")).select("l_orderkey", "l_partkey", "l_linenumber", "colour")


_LABELS = "SELECT l_orderkey, concat_ws(' ', l_linenumber - 2, l_quantity, l_tax, l_partkey % 7, CASE WHEN l_suppkey % 3 > 0 THEN 1 END, CASE WHEN l_suppkey % 3 > 0 THEN 2 END, 0.5, CASE WHEN l_suppkey % 5 = 0 THEN 1 END) AS line, l_linenumber, l_partkey FROM lineitem"


def _label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file with one line for each line item, some of them broken."""
    if_ = lambda cond, x: F.when(F.expr(cond), x)
    line = F.concat_ws(" ", (F.col("l_linenumber") - 2).cast("string"), F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"), (F.col("l_partkey") % 7).cast("string"), if_("l_suppkey % 3 > 0", "1"), if_("l_suppkey % 3 > 0", "2"), F.lit("0.5"), if_("l_suppkey % 5 = 0", "1"))
    return _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("image"), F.concat(line, F.lit("\n\n")).alias("text"))


_TOKENS = "4 + 2 * (l_suppkey % 3 > 0)::INT + 1 + (l_suppkey % 5 = 0)::INT"
_IMAGE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@_query(f"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN {_TOKENS} < 7 THEN 'fewer than three points' WHEN ({_TOKENS} - 1) % 2 <> 0 THEN 'odd number of coordinates' WHEN l_linenumber - 2 NOT BETWEEN 0 AND 2 THEN 'class out of range' END AS error FROM lineitem) GROUP BY error""")
def label_lines_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse_labels(_label_files(spark, sf_dir), "image", "text", 3, "strict").groupBy("error").agg(F.count("*").alias("n"))


@_query(f"SELECT {_IMAGE} AS image, CASE WHEN l_linenumber - 2 BETWEEN 0 AND 2 THEN l_linenumber - 2 END AS class_id, 0 AS line_no FROM lineitem")
def label_lines_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse_labels(_label_files(spark, sf_dir), "image", "text", 3, "lenient").select("image", "class_id", "line_no")


@_query(f"SELECT {_IMAGE} AS image, l_linenumber - 2 AS class_id FROM lineitem WHERE l_linenumber - 2 BETWEEN 0 AND 2")
def label_lines_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse_labels(_label_files(spark, sf_dir), "image", "text", 3, "skip").select("image", "class_id")


@_query("SELECT doc_id, (i - 1)::INT AS line_no, regexp_extract(ltrim(l, ' ' || chr(9) || chr(11) || chr(12)), '^[^ \\t\\x0B\\f]+') AS class_token FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS s FROM documents)) WHERE trim(l, ' ' || chr(9) || chr(11) || chr(12)) <> ''")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse_labels(_t(spark, sf_dir, "documents"), "doc_id", "text", 3, "token").select("doc_id", "line_no", "class_token")


_STARTS = "list_concat(range(0, greatest(1, {0} - 639), 512), CASE WHEN range(0, greatest(1, {0} - 639), 512)[-1] < {0} - 640 THEN [greatest(0, {0} - 640)] ELSE [] END)"


@_query(f"SELECT p_partkey, unnest({_STARTS.format('w')})::INT AS x0, y0::INT AS y0 FROM (SELECT p_partkey, w, unnest({_STARTS.format('h')}) AS y0 FROM (SELECT p_partkey, p_size * 64 AS w, p_size * 40 AS h FROM part))")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 64).alias("w"), (F.col("p_size") * 40).alias("h"))
    return detections.tiles(images, "w", "h").select("p_partkey", "x0", "y0")


_NMS = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY conf DESC, x1, y1, x2, y2) AS n FROM ({boxes})),
s AS (SELECT {keys}, n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf}}] AS kept FROM r WHERE n = 1
UNION ALL SELECT {own}, r.n, CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1)) > 0.3 *
((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))))) > 0 THEN kept
ELSE list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf}}) END FROM s JOIN r ON {same} AND r.n = s.n + 1)
SELECT {keys}, unnest(k) FROM (SELECT {keys}, unnest(kept) AS k FROM s QUALIFY n = max(n) OVER (PARTITION BY {keys}))"""


@_query(_NMS.format(keys="image, class_name", own="s.image, s.class_name", same="r.image = s.image AND r.class_name = s.class_name", boxes="SELECT l_orderkey AS image, l_returnflag AS class_name, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, l_partkey % 40 + l_quantity::DOUBLE AS x2, l_suppkey % 40 + l_quantity::DOUBLE AS y2, l_discount * 10 AS conf FROM lineitem"))
def class_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("class_name"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"), "conf")
    return detections.class_nms(rows, ["image", "class_name"])


@_query(_NMS.format(keys="image", own="s.image", same="r.image = s.image", boxes="SELECT l_suppkey AS image, (l_partkey % 200)::DOUBLE AS x1, (l_orderkey % 200)::DOUBLE AS y1, l_partkey % 200 + l_quantity::DOUBLE AS x2, l_orderkey % 200 + l_quantity::DOUBLE AS y2, l_discount * 10 AS conf FROM lineitem"))
def crowded_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 200).cast("double"), (F.col("l_orderkey") % 200).cast("double")
    rows = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("image"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"), "conf")
    return detections.class_nms(rows, ["image"], most=256)


@_query("""SELECT label, count(*) AS n, round(CASE WHEN a <= -90 THEN a + 180 ELSE a END, 4) AS angle_deg FROM (SELECT label, degrees(0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y))) AS a FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label) JOIN embeddings USING (label) GROUP BY label, a""")
def pca_angle_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return skeleton.principal_axis(points, "label").select("label", "n", F.round("angle_deg", 4).alias("angle_deg"))


@_query("SELECT vec_id, round(list_sum(list_transform(range(2, 33), lambda k: sqrt(pow(embedding[2 * k - 1]::DOUBLE - embedding[2 * k - 3]::DOUBLE, 2) + pow(embedding[2 * k]::DOUBLE - embedding[2 * k - 2]::DOUBLE, 2)))), 4) AS length_px FROM embeddings")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda odd: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.get("embedding", 2 * k + odd).cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(geometry.polyline_length(at(0), at(1)), 4).alias("length_px"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 64).cast("int").alias("x"), F.col("l_quantity").cast("int").alias("y")).distinct()


_PX = "WITH p AS (SELECT DISTINCT l_suppkey AS i, (l_partkey % 64)::INT AS x, trunc(l_quantity)::INT AS y FROM lineitem), n AS (SELECT a.i, a.x, a.y, abs(a.x - b.x) + abs(a.y - b.y) AS d, a.x < b.x OR (a.x = b.x AND a.y < b.y) AS up FROM p a JOIN p b ON a.i = b.i AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y))"


@_query(f"{_PX} SELECT kind, count(*) AS n FROM (SELECT CASE least(count(n.i), 3) WHEN 0 THEN 'isolated' WHEN 1 THEN 'end' WHEN 2 THEN 'path' ELSE 'branch' END AS kind FROM p LEFT JOIN n USING (i, x, y) GROUP BY p.i, p.x, p.y) GROUP BY kind")
def skeleton_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.degrees(_pixels(spark, sf_dir), "i").groupBy("kind").agg(F.count("*").alias("n"))


@_query(f"{_PX} SELECT p.i, round(coalesce(max(s), 0), 6) AS length_px FROM p LEFT JOIN (SELECT i, sum(CASE WHEN d = 2 THEN sqrt(2) ELSE 1 END) AS s FROM n WHERE up GROUP BY i) q ON p.i = q.i GROUP BY p.i")
def skeleton_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.skeleton_length(_pixels(spark, sf_dir), "i")


@_query("""WITH p AS (SELECT DISTINCT l_suppkey % 10 AS i, (l_partkey % 64)::INT AS x, trunc(l_quantity)::INT AS y FROM lineitem),
r AS (SELECT i, x, y, y - row_number() OVER (PARTITION BY i, x ORDER BY y) AS gap FROM p),
g AS (SELECT i, x, y, least(y - min(y) OVER w, max(y) OVER w - y) + 1 AS g FROM r WINDOW w AS (PARTITION BY i, x, gap)),
c AS (SELECT i, x AS cx, y, g FROM g UNION ALL SELECT i, cx, y, 0 FROM (SELECT DISTINCT i, y FROM p), (SELECT unnest(range(-1, 65)) AS cx) WHERE (i, y, cx) NOT IN (SELECT (i, y, x) FROM p))
SELECT g.i, g.x, g.y, min(c.g * c.g + (c.cx - g.x) * (c.cx - g.x))::BIGINT AS d2 FROM g JOIN c ON c.i = g.i AND c.y = g.y GROUP BY ALL""")
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.distance_transform(_pixels(spark, sf_dir).select((F.col("i") % 10).alias("i"), "x", "y"), "i")


@_query("""WITH p AS (SELECT DISTINCT l_suppkey % 20 AS image, l_suppkey AS i, (l_partkey % 16)::INT AS x, trunc(l_quantity)::INT % 12 AS y FROM lineitem),
e AS (SELECT image, i, x + dx AS x, y + dy AS y FROM p, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) GROUP BY ALL HAVING count(*) = 5)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.image = p.image AND e.i <> p.i AND e.x = p.x AND e.y = p.y)""")
def isolated_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("image"), F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_quantity").cast("int") % 12).alias("y")).distinct()
    return masks.isolate(rows, "image", "i")


@_query()
def nail_profile_from_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("i"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_quantity").cast("int") % 12).alias("y"))
    largest, ridge = distance.nail_masks(dense, "i")
    return skeleton.t_profile(largest, "i", skeleton=ridge)


_CLUSTERS = """WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS i, (l_partkey % 64)::INT AS x, trunc(l_quantity)::INT AS y FROM lineitem),
near AS (SELECT a.i, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.i = b.i AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
q AS ({of}),
link AS (SELECT a.i, a.kind, a.x, a.y, b.x AS nx, b.y AS ny FROM q a JOIN q b ON a.i = b.i AND a.kind = b.kind AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
spread AS (SELECT i, kind, x, y, y * 1000 + x AS c FROM q UNION SELECT s.i, s.kind, nx, ny, c FROM spread s JOIN link l ON s.i = l.i AND s.kind = l.kind AND s.x = l.x AND s.y = l.y WHERE c < ny * 1000 + nx),
least AS (SELECT i, kind, x, y, min(c) AS c FROM spread GROUP BY ALL),
parts AS (SELECT i, kind, c, count(*) AS pixels, round_even(avg(x), 0)::INT AS x, round_even(avg(y), 0)::INT AS y, min(x)::INT AS "left", max(x)::INT AS "right", max(y)::INT AS bottom FROM least GROUP BY ALL)"""


@_query(_CLUSTERS.format(of="SELECT *, 'set' AS kind FROM p") + ' SELECT i, (c // 1000)::INT AS top_y, (c % 1000)::INT AS top_x, pixels, x, y, "left", "right", bottom FROM parts')
def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.component_table(_pixels(spark, sf_dir), "i")


@_query(_CLUSTERS.format(of="SELECT *, 'set' AS kind FROM p") + " SELECT i, least.x, least.y FROM least JOIN (SELECT i, arg_min(c, (-pixels) * 100000000 + c) AS c FROM parts GROUP BY i) USING (i, c)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.largest_component(_pixels(spark, sf_dir), "i")


@_query(_CLUSTERS.format(of="SELECT i, x, y, CASE WHEN count(*) = 1 THEN 'end' ELSE 'branch' END AS kind FROM near GROUP BY ALL HAVING count(*) <> 2") + " SELECT i, kind, x, y, pixels FROM parts")
def skeleton_ends_and_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.ends_and_branches(_pixels(spark, sf_dir), "i")


@_query()
def beam_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.beam_geometry(_pixels(spark, sf_dir), "i")


@_query("""WITH p AS (SELECT DISTINCT l_suppkey AS i, (l_partkey % 64)::INT AS x, trunc(l_quantity)::INT AS y FROM lineitem),
m AS (SELECT i, avg(x) AS cx, avg(y) AS cy, CASE WHEN count(*) >= 4 AND var_samp(x) + var_samp(y) > 0 THEN 0.5 * atan2(2 * covar_samp(x, y) + 0.0, var_samp(x) - var_samp(y)) END AS t FROM p GROUP BY i),
r AS (SELECT i, (x - cx) * cos(t) + (y - cy) * sin(t) AS u, (y - cy) * cos(t) - (x - cx) * sin(t) AS v FROM p JOIN m USING (i)),
e AS (SELECT i, min(u) AS lo, max(u) AS hi, least(greatest(0.18 * (max(u) - min(u)), 6), 28) AS band FROM r GROUP BY i),
b AS (SELECT i, side, CASE WHEN count(*) >= 3 THEN quantile_cont(v, 0.92) - quantile_cont(v, 0.08) ELSE 0 END AS w, CASE WHEN count(*) >= 3 THEN median(v) ELSE 0 END AS mid,
CASE WHEN count(*) >= 3 THEN median(u) WHEN side = 0 THEN any_value(lo) ELSE any_value(hi) END AS cap
FROM r JOIN e USING (i), (VALUES (0), (1)) s(side) WHERE CASE side WHEN 0 THEN u <= lo + band ELSE u >= hi - band END GROUP BY i, side),
h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(w, 6) DESC, side) = 1),
g AS (SELECT i, t, cx, cy, w, mid, cap, hi - lo AS l, CASE side WHEN 0 THEN hi ELSE lo END AS tip, least(greatest(0.45 * w, 0.045 * (hi - lo), 5), 18) AS half FROM m LEFT JOIN e USING (i) LEFT JOIN h USING (i)),
k AS (SELECT i, t, l, CASE WHEN l > 1 THEN 1 END AS ok, cx + tip * cos(t) AS tx, cy + tip * sin(t) AS ty, cx + cap * cos(t) - mid * sin(t) AS hx, cy + cap * sin(t) + mid * cos(t) AS hy, half * sin(t) AS sx, half * cos(t) AS sy FROM g),
z AS (SELECT i, t, ok, round_even(round(tx, 6), 0)::INT * ok AS tip_x, round_even(round(ty, 6), 0)::INT * ok AS tip_y, round_even(round(hx, 6), 0)::INT * ok AS head_x, round_even(round(hy, 6), 0)::INT * ok AS head_y,
round_even(round(hx + sx, 6), 0)::INT * ok AS cap_x1, round_even(round(hy - sy, 6), 0)::INT * ok AS cap_y1, round_even(round(hx - sx, 6), 0)::INT * ok AS cap_x2, round_even(round(hy + sy, 6), 0)::INT * ok AS cap_y2 FROM k)
SELECT i, round(CASE WHEN degrees(t) <= -90 THEN degrees(t) + 180 ELSE degrees(t) END, 6) AS angle_deg, round(coalesce(sqrt((head_x - tip_x) ** 2 + (head_y - tip_y) ** 2), 0), 6) AS length_px,
tip_x, tip_y, head_x, head_y, cap_x1, cap_y1, cap_x2, cap_y2, CASE ok WHEN 1 THEN 'ok_t_profile_skeleton' ELSE 'needs_review_no_clear_t_profile' END AS status FROM z""")
def nail_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.t_profile(_pixels(spark, sf_dir), "i")


_PLACE = "('0x' || substr(sha1(n_nationkey::VARCHAR), 1, 7))::BIGINT / 268435456.0"


@_query(f"SELECT n_nationkey, CASE WHEN {_PLACE} < 0.7 THEN 'train' WHEN {_PLACE} < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM nation")
def group_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.by_hash(_t(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@_query(f"""WITH s AS (SELECT l_orderkey AS image, l_returnflag AS cls, CASE WHEN {_PLACE.replace('n_nationkey', 'o_custkey')} < 0.7 THEN 'train' WHEN {_PLACE.replace('n_nationkey', 'o_custkey')} < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT split, ratio::DOUBLE AS ratio FROM (VALUES ('train', 0.7), ('val', 0.15), ('test', 0.15)) v(split, ratio)),
c AS (SELECT split, ratio, cls, n, m FROM r, (SELECT cls, count(*) AS n, count(DISTINCT image) AS m FROM s GROUP BY cls)),
p AS (SELECT 4 * abs(count(DISTINCT image) / (SELECT count(DISTINCT image) FROM s) - ratio) AS part FROM r LEFT JOIN s USING (split) GROUP BY split, ratio
UNION ALL SELECT abs(count(image) / n - ratio) + 2 * abs(count(DISTINCT image) / m - ratio) + CASE WHEN split <> 'train' AND count(image) = 0 THEN 3 ELSE 0 END FROM c LEFT JOIN s USING (split, cls) GROUP BY split, cls, ratio, n, m)
SELECT round(sum(part), 6) AS score FROM p""")
def split_ratio_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    dealt = split.by_hash(rows.select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("cls"), "o_custkey"), "o_custkey")
    return split.ratio_score(dealt, "split", "image", "cls")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("image"), F.col("c_mktsegment").alias("cls"))


@_query("SELECT c_nationkey AS grp, count(DISTINCT c_custkey) AS images, count(*) AS instances FROM customer GROUP BY 1")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = split.group_payload(_grouped(spark, sf_dir), "grp", "image", "cls")
    return payload.select("grp", "images", F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("instances"))


@_query()
def split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.search(_grouped(spark, sf_dir), "grp", "image", "cls")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))
    method = F.when(F.col("l_linenumber") == 1, "longest_path").when(F.col("l_linenumber") == 2, "t_profile_skeleton").when(F.col("l_linenumber") == 3, "mask_axis")
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("detection_index"), F.when(F.col("l_returnflag") == "R", "I-Beam").otherwise(F.col("l_returnflag")).alias("class"), F.col("conf").alias("confidence"),
        F.col("l_quantity").alias("length_px"), F.col("l_tax").alias("angle_deg"), method.alias("geometry_method"), F.array(point("l_partkey", "l_suppkey"), point("l_suppkey", "l_quantity")).alias("endpoints"),
        F.when(F.col("l_linenumber") == 2, F.array().cast("array<struct<x:int,y:int>>")).otherwise(F.array(point("l_linenumber", "l_quantity"))).alias("branch_points"), F.col("l_linestatus").alias("status"),
    )


@_query("""SELECT l_orderkey AS Instance, l_linenumber AS "Detection Index", CASE l_returnflag WHEN 'R' THEN 'I-Beam' ELSE l_returnflag END AS Class, l_discount * 10 AS Confidence, l_quantity AS "Length (px)", l_tax AS "Angle (deg)",
CASE l_linenumber WHEN 1 THEN 'longest_path' WHEN 2 THEN 't_profile_skeleton' WHEN 3 THEN 'mask_axis' ELSE 'clean_overlay' END AS Method, '(' || l_partkey || ', ' || l_suppkey || '); (' || l_suppkey || ', ' || trunc(l_quantity)::INT || ')' AS Endpoints, 2 AS "Endpoint Count",
CASE l_linenumber WHEN 1 THEN '(1, ' || trunc(l_quantity)::INT || ')' WHEN 2 THEN '' ELSE 'N/A' END AS "Branch Points", CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '0' ELSE 'N/A' END AS "Branch Point Count", l_linestatus AS Status FROM lineitem""")
def geometry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.geometry_rows(_shapes(spark, sf_dir))


@_query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def beam_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.class_rows(samples.geometry_rows(_shapes(spark, sf_dir)), "i-beam")


@_query("SELECT folder, name, rank FROM (SELECT n_name AS folder, s_name AS name, n_regionkey AS rank, row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3) WHERE k = 1")
def model_registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _t(spark, sf_dir, "nation")
    files = _t(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("folder"), F.col("s_name").alias("name"))
    return reports.visible_models(files, {r["n_name"]: r["n_regionkey"] for r in nations.where("n_regionkey < 3").collect()}).select("folder", "name", "rank")


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def metrics_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@_query("SELECT l_orderkey, string_agg(l_returnflag || ': ' || n, ' | ' ORDER BY lower(l_returnflag)) AS breakdown FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def class_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n"))
    return per.groupBy("l_orderkey").agg(text.breakdown_text(F.collect_list(F.struct("name", "n"))).alias("breakdown"))


@_query("SELECT vec_id, '(' || trunc(embedding[1] * 100)::INT || ', ' || trunc(embedding[2] * 100)::INT || ')' AS points FROM embeddings")
def point_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: (F.col("embedding")[k] * F.lit(100).cast("float")).cast("int")
    return _t(spark, sf_dir, "embeddings").select("vec_id", text.points_text(F.array(F.struct(at(0).alias("x"), at(1).alias("y")))).alias("points"))


@_query("SELECT source_group, count(*) AS n FROM (SELECT lower(regexp_extract(c_mktsegment || '.rf.' || c_custkey || '.jpg', '^(.*?)\\.rf\\.', 1)) AS source_group FROM customer) GROUP BY 1")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_mktsegment", F.lit(".rf."), "c_custkey", F.lit(".jpg"))
    return _t(spark, sf_dir, "customer").groupBy(labels.source_group(name).alias("source_group")).agg(F.count("*").alias("n"))


@_query("SELECT 'train' AS split, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'val', s_suppkey, s_name FROM supplier UNION ALL SELECT 'test', n_nationkey, n_name FROM nation")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda table, key, name: _t(spark, sf_dir, table).select(F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
    return samples.union_splits({"train": part("customer", "c_custkey", "c_name"), "val": part("supplier", "s_suppkey", "s_name"), "test": part("nation", "n_nationkey", "n_name")}).select("split", "id", "name")


@_query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def collected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return samples.collect_samples(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), files, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "o_orderstatus")


@_query("SELECT class_name, count(*) AS n FROM (SELECT coalesce(n_name, c_nationkey::VARCHAR) AS class_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey) GROUP BY 1")
def class_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("class_name"))
    return samples.named(_t(spark, sf_dir, "customer"), names, "c_nationkey", "class_name").groupBy("class_name").agg(F.count("*").alias("n"))


@_query("SELECT l_orderkey, coalesce(sum(n) FILTER (lower(l_returnflag) = 'a'), 0)::BIGINT AS n FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def class_count_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return samples.class_count(per, "l_orderkey", "l_returnflag", "n", "a", "l_returnflag")


@_query("SELECT c_custkey, e.ending FROM customer LEFT JOIN (SELECT l_suppkey AS c_custkey, min_by(ending, k) AS ending FROM (SELECT DISTINCT l_suppkey, CASE l_returnflag WHEN 'A' THEN '.PNG' WHEN 'N' THEN '.jpg' ELSE '.gif' END AS ending, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 END AS k FROM lineitem WHERE l_returnflag IN ('A', 'N')) GROUP BY 1) e USING (c_custkey)")
def label_image_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("l_returnflag") == "A", ".PNG").when(F.col("l_returnflag") == "N", ".jpg").otherwise(".gif")
    images = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("c_custkey"), ending.alias("ending"))
    return samples.label_images(_t(spark, sf_dir, "customer").select("c_custkey"), images, "c_custkey", "ending", [".jpg", ".png"])


@_query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def first_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.struct("p_name", "p_partkey").alias("path"))
    return samples.first_by_path(rows, "path").select("p_partkey", "p_name")


@_query("SELECT page_id, sha1(html) AS digest, round(page_id / 7.0, 6) AS conf, page_id % 2 = 0 AS preprocess FROM pages")
def inference_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = samples.cache_key(F.col("html"), F.lit("m"), F.col("page_id") / 7.0, F.lit(0.7), F.lit(1024), F.col("page_id") % 2 == 0)
    return _t(spark, sf_dir, "pages").select("page_id", key.alias("key")).select("page_id", "key.digest", "key.conf", "key.preprocess")


@_query("SELECT CASE WHEN r.o_orderkey IS NULL THEN 'image' ELSE 'label' END AS side, coalesce(r.o_orderkey, f.l_orderkey) AS image FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0) r FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 7 > 0) f ON o_orderkey = l_orderkey WHERE r.o_orderkey IS NULL OR f.l_orderkey IS NULL")
def audit_missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("image"))
    files = _t(spark, sf_dir, "lineitem").where("l_orderkey % 7 > 0").select(F.col("l_orderkey").alias("image"))
    return audit.audit(images, files.distinct(), files.withColumns({"split": F.lit("a"), "cls": F.lit("b")}), "image", "split", "cls")["missing"]


@_query("SELECT CASE WHEN l.k IS NULL THEN 'missing' WHEN i.k IS NULL THEN 'empty' ELSE 'labelled' END AS state, count(*) AS images FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 7 > 0) l ON o_orderkey = l.k LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 7 > 0 AND l_returnflag = 'R') i ON o_orderkey = i.k GROUP BY 1")
def audit_label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "lineitem").where("l_orderkey % 7 > 0").select(F.col("l_orderkey").alias("image"), "l_returnflag")
    return audit.label_states(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")), files, files.where("l_returnflag = 'R'"), "image")


@_query("""WITH r AS (SELECT o_orderstatus AS split, l_returnflag AS cls, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o.split, c.cls, count(l_orderkey) AS instances, count(DISTINCT l_orderkey) AS images FROM (VALUES ('F'), ('O'), ('X')) o(split) CROSS JOIN (VALUES ('A'), ('R'), ('Z')) c(cls) LEFT JOIN r ON r.split = o.split AND r.cls = c.cls GROUP BY 1, 2
UNION ALL SELECT NULL, c.cls, count(l_orderkey), count(DISTINCT l_orderkey) FROM (VALUES ('A'), ('R'), ('Z')) c(cls) LEFT JOIN r ON r.cls = c.cls GROUP BY 2""")
def audit_filled_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    n = parts(spark, lines.count())  # from the files' footers
    rows = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("split"), F.col("l_returnflag").alias("cls"), F.col("l_orderkey").alias("image"))
    return audit.filled_balance(audit.class_balance(rows, "split", "cls", "image"), ["F", "O", "X"], ["A", "R", "Z"], "split", "cls")


def _balanced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("cls"))
    images = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderstatus").alias("split"), F.concat("o_orderkey", F.lit(".a.JPG")).alias("file_name"))
    return balance.balanced(images, lines, "image", "cls", ["R"], ["F"]), lines


_COPIES = "WITH c AS (SELECT o_orderkey AS image, o_orderstatus AS split, unnest(range(CASE WHEN o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 4 ELSE 1 END)) AS k FROM orders)"


@_query(f"{_COPIES} SELECT image, split, image || '.a' || CASE WHEN k > 0 THEN '_bal' || k ELSE '' END || '.JPG' AS output_name FROM c")
def balanced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balanced(spark, sf_dir)[0].select("image", "split", "output_name")


@_query(f"{_COPIES} SELECT split, l_returnflag AS cls, count(*) AS instances FROM c JOIN lineitem ON l_orderkey = image GROUP BY 1, 2")
def balanced_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies, lines = _balanced(spark, sf_dir)
    return balance.counts_after(copies, lines, "image", "cls")
