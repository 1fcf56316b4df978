"""Queries and oracles of keyed evaluation, neighbour information and principal axes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gram as GR
from ..operators import neighbors as NB
from ..operators import pairing as PA
from ..operators import score as SCR
from ..operators import labels as TAX
from ..session import scratch_path
from ..sources import snapshots as SN
from ..streaming import exact as EX
from .registry import FEATS, KEY, r, register
from .tables import EVENTS_TAXONOMY, EVENTS_TAXONOMY_SQL, FLOWS_SQL, dirty_flows, table

# --------------------------------------------------------------------------- JOIN-04

_TRUTH_SQL = """truth AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 103 <> 0
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 103 <> 0 AND l_partkey % 211 = 0),
pred AS (
  SELECT CASE WHEN l_orderkey % 89 = 0 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_quantity >= 40 THEN 'R' WHEN l_discount >= 0.05 THEN 'A' ELSE 'N' END AS prediction FROM lineitem WHERE l_orderkey % 97 <> 0),
preds AS (SELECT * FROM pred UNION ALL SELECT * FROM pred WHERE l_suppkey % 17 = 0),
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n_t, max(l_returnflag) AS truth FROM truth GROUP BY 1, 2, 3, 4),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n_p, max(prediction) AS prediction FROM preds GROUP BY 1, 2, 3, 4),
j AS (SELECT *, CASE WHEN n_p IS NULL THEN 'only_truth' WHEN n_t IS NULL THEN 'only_prediction' WHEN n_t > 1 AND n_p > 1 THEN 'repeated_both'
                     WHEN n_t > 1 THEN 'repeated_truth' WHEN n_p > 1 THEN 'repeated_prediction' ELSE 'paired' END AS state
      FROM t FULL JOIN p USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


def keyed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Truth and predictions, each written on its own with missing, foreign and repeated keys, joined by key."""
    li, k = table(spark, d, "lineitem"), F.col("l_orderkey")
    truth = li.where(k % 103 != 0).select(*KEY, "l_returnflag")
    truth = truth.unionByName(truth.where(F.col("l_partkey") % 211 == 0))
    rule = F.when(F.col("l_quantity") >= 40, "R").when(F.col("l_discount") >= 0.05, "A").otherwise("N")
    pred = li.where(k % 97 != 0).select(F.when(k % 89 == 0, -k).otherwise(k).alias("l_orderkey"), *KEY[1:], rule.alias("prediction"))
    pred = pred.unionByName(pred.where(F.col("l_suppkey") % 17 == 0))
    return PA.pair_predictions(PA.write_keyed(truth, KEY), PA.write_keyed(pred, KEY), KEY, "l_returnflag", "prediction")


@register("keyed_pairing", f"""
WITH {_TRUTH_SQL},
states AS (SELECT unnest(['paired', 'only_truth', 'only_prediction', 'repeated_truth', 'repeated_prediction', 'repeated_both']) AS state)
SELECT s.state, count(j.state) AS keys, CAST(coalesce(sum(n_t), 0) AS BIGINT) AS truth_rows, CAST(coalesce(sum(n_p), 0) AS BIGINT) AS prediction_rows
FROM states s LEFT JOIN j ON j.state = s.state GROUP BY s.state
""")
def keyed_pairing(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-04: keys and rows by state of the keyed join of truth and predictions."""
    return PA.pairing_report(keyed_pairs(spark, d))


@register("keyed_evaluation", f"""
WITH {_TRUTH_SQL},
o AS (SELECT truth, prediction FROM j WHERE state = 'paired'),
c AS (SELECT DISTINCT truth AS cls FROM o UNION SELECT DISTINCT prediction FROM o)
SELECT cls, (SELECT count(*) FROM o WHERE truth = cls) AS support, (SELECT count(*) FROM o WHERE prediction = cls) AS predicted,
       (SELECT count(*) FROM o WHERE truth = cls AND prediction = cls) AS hits,
       round((SELECT count(*) FROM o WHERE truth = cls AND prediction = cls)::DOUBLE / nullif((SELECT count(*) FROM o WHERE truth = cls), 0), 6) AS recall,
       (SELECT count(*) FROM o WHERE truth = cls AND cls <> 'N' AND prediction = 'N') AS missed_as_normal
FROM c
""")
def keyed_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-04: hits, recall and attacks taken for normal by class, over the keys that both sides hold once."""
    o = keyed_pairs(spark, d).where("state = 'paired'")
    each = o.select(F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit("t").alias("side"), (F.col("truth") == F.col("prediction")).alias("hit"),
                                                ((F.col("truth") != "N") & (F.col("prediction") == "N")).alias("missed")),
                                      F.struct(F.col("prediction").alias("cls"), F.lit("p").alias("side"), F.lit(False).alias("hit"), F.lit(False).alias("missed")))).alias("x")).select("x.*")
    count = lambda c: F.sum(c.cast("bigint"))
    out = each.groupBy("cls").agg(count(F.col("side") == "t").alias("support"), count(F.col("side") == "p").alias("predicted"), count(F.col("hit")).alias("hits"), count(F.col("missed")).alias("missed_as_normal"))
    return out.withColumn("recall", F.round(F.try_divide(F.col("hits").cast("double"), F.col("support")), 6))


# --------------------------------------------------------------------------- VAL-16

_DIGAMMA = "(ln({x} + 6) - 0.5 / ({x} + 6) - (1.0 / 12 - (1.0 / 120 - (1.0 / 252 - 1.0 / 240 / pow({x} + 6, 2)) / pow({x} + 6, 2)) / pow({x} + 6, 2)) / pow({x} + 6, 2) - 1.0 / {x} - 1.0 / ({x} + 1) - 1.0 / ({x} + 2) - 1.0 / ({x} + 3) - 1.0 / ({x} + 4) - 1.0 / ({x} + 5))"


def psi_sql(x: str) -> str:
    return _DIGAMMA.replace("{x}", f"({x})::DOUBLE")


def neighbour_sql(source: str, features: list[str], label: str) -> str:
    """The estimator of VAL-16 in SQL for k = 3: lags and leads within a class, counts by value ranges (table named ``mi``)."""
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {label} AS y, CASE WHEN isnan({f}) OR isinf({f}) THEN NULL ELSE {f} END AS x FROM {source}" for f in features)
    near = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END"
    lag = lambda i: f"(v - lag(v, {i}) OVER w)"
    lead = lambda i: f"(lead(v, {i}) OVER w - v)"
    return f"""
raw AS (SELECT * FROM ({parts}) WHERE x IS NOT NULL AND y IS NOT NULL),
scales AS (SELECT feature, CASE WHEN max(abs(x)) = 0 THEN 1.0 ELSE pow(2.0, 40 - ceil(log2(max(abs(x))))) END AS s FROM raw GROUP BY feature),
grid AS (SELECT feature, y, floor(x * s + 0.5)::BIGINT AS v, count(*) OVER (PARTITION BY feature, y) AS size FROM raw JOIN scales USING (feature)),
d AS (SELECT *, {lead(1)} AS n1, {lead(2)} AS n2, {lead(3)} AS n3, {lag(1)} AS l1, {lag(2)} AS l2, {lag(3)} AS l3 FROM grid WHERE size > 1
      WINDOW w AS (PARTITION BY feature, y ORDER BY v)),
rad AS (SELECT feature, v, size, least(3, size - 1) AS k,
               CASE WHEN size > 3 THEN least(n3, {near('l1', 'n2')}, {near('l2', 'n1')}, l3)
                    WHEN size = 3 THEN least(n2, {near('l1', 'n1')}, l2) ELSE least(n1, l1) END AS r FROM d),
cnt AS (SELECT feature, k, size, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN greatest(r - 1, 0) PRECEDING AND greatest(r - 1, 0) FOLLOWING) AS m,
               count(*) OVER (PARTITION BY feature) AS n FROM rad),
mi AS (SELECT feature, greatest(0.0, {psi_sql('max(n)')} + avg({psi_sql('k')}) - avg({psi_sql('size')}) - avg({psi_sql('m')})) AS mutual_info FROM cnt GROUP BY feature)"""


@register("neighbour_mutual_info", f"WITH {neighbour_sql('lineitem', FEATS, 'l_returnflag')} SELECT feature, round(mutual_info, 6) AS mutual_info FROM mi")
def neighbour_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    """VAL-16: nearest-neighbour mutual information of each feature with the class."""
    return NB.neighbour_mutual_information(table(spark, d, "lineitem"), FEATS, "l_returnflag").select("feature", r("mutual_info").alias("mutual_info"))


# --------------------------------------------------------------------------- SCR-04

@register("benign_covariance", """
WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE label = 0)
SELECT a.i AS i, b.i AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i
""")
def benign_covariance(spark: SparkSession, d: str) -> DataFrame:
    """SCR-04 fit: covariances of all pairs of components over benign vectors, from the distributed Gram matrix."""
    g = GR.vector_gram(table(spark, d, "embeddings").where("label = 0"), "embedding", 64).covariance()
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(64) for j in range(i, 64)], "i bigint, j bigint, cov double").select("i", "j", r("cov", 9).alias("cov"))


@register("axes_reconstruction", """
WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM e WHERE label = 0 GROUP BY i),
c AS (SELECT vec_id, label, e.i, x - m AS x FROM e JOIN m ON e.i = m.i),
p AS (SELECT vec_id, k, pow(sum(x * CASE WHEN bit_count(i & k) % 2 = 0 THEN 0.125 ELSE -0.125 END), 2) AS kept FROM c, range(0, 12) AS t(k) GROUP BY vec_id, k),
q AS (SELECT vec_id, any_value(label) AS label, sum(x * x) AS total FROM c GROUP BY vec_id),
err AS (SELECT q.label, greatest(total - kept, 0) / 64 AS err FROM q JOIN (SELECT vec_id, sum(kept) AS kept FROM p GROUP BY vec_id) USING (vec_id)),
thr AS (SELECT quantile_cont(err, 0.99) AS t FROM err WHERE label = 0)
SELECT label, count(*) AS rows, round(avg(err), 8) AS mean_error, round(max(err), 8) AS max_error, round(max(t), 8) AS threshold,
       CAST(sum(CASE WHEN err > t THEN 1 ELSE 0 END) AS BIGINT) AS above
FROM err, thr GROUP BY label
""")
def axes_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """SCR-04: reconstruction errors from twelve fixed orthonormal axes, and the p99 threshold of benign rows."""
    emb = table(spark, d, "embeddings")
    mean = GR.vector_gram(emb.where("label = 0"), "embedding", 64).mean()
    axes = [[0.125 if bin(i & k).count("1") % 2 == 0 else -0.125 for i in range(64)] for k in range(12)]
    return _errors_by_label(emb, GR.PrincipalAxes(mean, axes, [0.0] * 12))


def _errors_by_label(emb: DataFrame, fitted: GR.PrincipalAxes) -> DataFrame:
    err = emb.select("label", GR.axes_error(F.col("embedding"), fitted).alias("err"))
    t = SCR.calibrate_threshold(err.where("label = 0"), "err", 0.99)
    return err.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("err"), 8).alias("mean_error"), r(F.max("err"), 8).alias("max_error"),
                                    F.round(F.lit(t), 8).alias("threshold"), F.sum((F.col("err") > t).cast("bigint")).alias("above"))


@register("axes_anomaly")
def axes_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """SCR-04: axes fitted on benign rows, threshold at the 99th percentile of their errors, rows above it by class."""
    emb = table(spark, d, "embeddings")
    return _errors_by_label(emb, GR.fit_axes(emb.where("label = 0"), "embedding", 12))




# --------------------------------------------------------------------------- STR-05, SNK-08, SRC-10

@register("exact_stream_dedup", f"""
WITH {FLOWS_SQL}
SELECT l_returnflag, count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM (SELECT DISTINCT * FROM flows_all) GROUP BY l_returnflag
""")
def exact_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """STR-05: a stream of files that repeat each other's rows, in no order of time, keeps every distinct row once."""
    df = dirty_flows(spark, d)
    path = scratch_path(spark, "repeated-files")
    df.where("l_linenumber % 2 = 0").write.parquet(path + "/a")
    df.where("l_linenumber % 3 > 0").write.parquet(path + "/b")
    df.where("l_linenumber % 2 = 1").write.parquet(path + "/c")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(path)
    base = scratch_path(spark, "seen-rows")
    log = SN.SnapshotLog(spark, base + "/log")
    EX.dedup_to_log(src, log, base + "/ckpt", ts="l_shipdate", delay_seconds=86_400.0, parts=8).awaitTermination()
    return EX.distinct_rows(log).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_orderkey").alias("orders"))


@register("committed_alerts", f"""
WITH {EVENTS_TAXONOMY_SQL},
rec AS (SELECT event_id, coalesce(tax.category, 'Other') AS category, coalesce(tax.severity, 'medium') AS severity FROM events e
        LEFT JOIN tax ON trim(e.event_type) = tax.raw_label AND tax.dataset = 'events')
SELECT category, count(*) AS records, CAST(sum(CASE WHEN category IN ('DoS', 'Probe', 'R2L', 'U2R') THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM rec GROUP BY category
""")
def committed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """SNK-08 / STR-03: streamed epochs of records and alerts, read together at the newest committed epoch."""
    ev = table(spark, d, "events")
    base = scratch_path(spark, "committed")
    ev.repartition(3, "event_id").write.parquet(base + "/in")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    log = SN.SnapshotLog(spark, base + "/log")
    EX.score_to_log(TAX.map_labels(src, "event_type", "events", TAX.taxonomy(spark, EVENTS_TAXONOMY)), log, base + "/ckpt", "event_id", "event_type").awaitTermination()
    newest = log.latest()
    records, alerts = log.read("records", newest), log.read("alerts", newest)
    raised = alerts.select(F.col("traffic_record_id").alias("event_id"), F.lit(1).alias("raised"))
    return records.join(raised, "event_id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("records"), F.count("raised").alias("alerts"))


@register("training_snapshot", f"""
SELECT split, count(*) AS rows, {', '.join(f"round(avg(least(greatest(({f} - lo_{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1 ELSE hi_{f} - lo_{f} END, 0.0), 1.0)), 6) + 0.0 AS {f}" for f in FEATS)}
FROM (SELECT *, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM lineitem),
     (SELECT {', '.join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATS)} FROM lineitem WHERE l_orderkey % 10 < 7) GROUP BY split
""")
def training_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10 / SNK-01..04: splits, contract and scaler published as one version, then loaded and applied."""
    from ..operators import fit as FIT
    k = F.col("l_orderkey") % 10
    li = table(spark, d, "lineitem").withColumn("split", F.when(k < 7, "train").when(k < 8, "val").otherwise("test"))
    log = SN.SnapshotLog(spark, scratch_path(spark, "training"))
    SN.publish_training(log, 1, li.select(*FEATS, "l_returnflag", "split"), FEATS, "l_returnflag", FIT.fit_scaler(li.where("split = 'train'"), FEATS, "minmax"))
    got = SN.load_training(log)
    parts = [got["splits"][n] for n in sorted(got["splits"])]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    scaled = FIT.apply_scaler(everything, got["scaler"], keep=["split"])
    return scaled.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *[r(F.avg(f)).alias(f) for f in got["contract"]["features"]])


# --------------------------------------------------------------------------- SRC-08, MOD-06

@register("first_rows", """
SELECT l_linenumber, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS orders, round(sum(l_extendedprice), 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) AS place FROM lineitem) WHERE place <= 250 GROUP BY l_linenumber
""")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08: the first 250 rows of each of many files, in the order of their lines."""
    from ..sources.csv import load_folder
    path = scratch_path(spark, "line-files")
    li = table(spark, d, "lineitem")
    # one file a line number, sorted within
    li.repartition("l_linenumber").sortWithinPartitions("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey").select(
        F.col("l_linenumber").alias("folder"), *li.columns).write.option("header", "true").partitionBy("folder").csv(path)
    rows = load_folder(spark, path, "flows", numeric=["l_orderkey", "l_extendedprice", "l_linenumber"], first_rows=250)
    return rows.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").cast("bigint").alias("orders"), r(F.sum("l_extendedprice"), 2).alias("price"))


@register("boosting_rounds")
def boosting_rounds(spark: SparkSession, d: str) -> DataFrame:
    """MOD-06: training loss of multiclass boosting before each round and after the last (it must fall every round)."""
    from ..operators.boosting import fit_boosting
    model = fit_boosting(table(spark, d, "lineitem"), FEATS, "l_returnflag", rounds=8, depth=5, rate=0.1)
    return spark.createDataFrame(list(enumerate(model.losses)), "round int, log_loss double")
