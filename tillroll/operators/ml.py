"""Models on Spark ML: demand regressors, tuned boosting, AR(30), forecast
reports, K-means segments and PCA.

The reference trains scikit-learn, XGBoost, Prophet and Keras models on one
machine; here every fit is a ``pyspark.ml`` estimator over DataFrames, so
the data never passes through the driver.  Only model parameters (a few
dozen coefficients, cluster centres) come back to it.

Splits:
* ``random_split`` hashes the seeded row key (md5): stable under
  repartitioning and re-execution, unlike ``randomSplit``;
* ``chrono_split`` (in ``features``) takes the first 80 % of days.

Inputs: the demand models are fitted on the causal frame (windows end on the
row before), the tuned booster on causal features without the same day's units,
customers and transactions, so no feature holds the target.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators import boosting as BO
from tillroll.operators import clustering as CL
from tillroll.operators import forecast as FC

SEED = 42
TEST_PERCENT = 20
V1_FEATURES = ("day_of_week", "month", "quarter", "is_weekend", "lag1", "lag7", "rolling_mean_7", "product_code")
RF_TREES = 100
RF_DEPTH = 10            # trees stop at this depth (Spark allows 30 at most)
GBT_ROUNDS = 100
GBT_DEPTH = 3
GBT_STEP = 0.1
# The search space of the tuned booster.
TUNING_TRIALS = 20
TUNING_ROUNDS = (100, 300)
TUNING_DEPTH = (3, 8)
TUNING_STEP = (0.01, 0.1)
TUNING_SAMPLE = (0.6, 1.0)
KMEANS_K = 4
KMEANS_RESTARTS = 10
KMEANS_ROUNDS = 300
PCA_K = 2
INTERVAL_Z = 1.2815515655446004  # standard normal quantile at 0.9 (80 % band)
HORIZON = 90
PARALLELISM = 8          # concurrent fits (Spark jobs) submitted by the driver


ROWS_PER_PARTITION = 100_000
FULL_PARTITIONS = 24     # from here on partitions grow to ``ROWS_AT_MOST`` rows
ROWS_AT_MOST = 1_000_000


def ml_partitions(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Partitions for an iterative fit, by the rows alone (one job to count
    them): the same on every cluster, so that fits whose result depends on the
    partitioning don't change with its size.

    Every partition sends the statistics of all open tree nodes to a shuffle in
    each pass, however few rows it has, so a large frame gets larger partitions
    before it gets more of them."""
    n = df.count()
    return max(1, min(-(-n // rows_per_partition), max(FULL_PARTITIONS, -(-n // ROWS_AT_MOST))))


def materialized(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared checkpoint folder.

    A fit reads its input several times (scaler statistics, the row count
    for sizing, the cache fill, horizon bounds); materialising the input once
    keeps the upstream aggregation of the lines from running again for each
    read."""
    from tillroll.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` hash-partitioned on ``key`` into ``ml_partitions`` partitions."""
    return df.repartition(ml_partitions(df), *[F.col(k) for k in key])


def in_parallel(tasks: Sequence[Callable[[], object]], workers: int = PARALLELISM) -> list:
    """Run independent fits as concurrent Spark jobs (like ``parallelism`` in
    ``pyspark.ml.tuning``); results in task order."""
    if workers <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(workers, len(tasks))) as pool:
        return list(pool.map(lambda t: t(), tasks))


def split_bucket(key: Sequence[str], seed: int = SEED):
    """0..99 from the seeded row key: the first 32 bits of md5('seed|k1|k2..')
    mod 100.  A function of the key only (stable under repartitioning and
    re-execution), and md5 has the same value in any SQL engine, so the
    split can be checked against the oracle."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(100))


def random_split(df: DataFrame, key: Sequence[str], test_percent: int = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    bucket = split_bucket(key, seed)
    return df.withColumn("split", F.when(bucket < 100 - test_percent, F.lit("train")).otherwise(F.lit("test")))


def _assemble(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


MODEL_ORDER = ("Linear Regression", "Random Forest", "Gradient Boosting")  # ties go to the earlier


def _regressors(rounds: int = GBT_ROUNDS, bins: int = 32):
    return {
        "Linear Regression": LinearRegression(featuresCol="features", labelCol="label", solver="normal", regParam=0.0),
        "Random Forest": RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=RF_TREES,
                                               featureSubsetStrategy="all", maxDepth=RF_DEPTH, maxBins=bins, seed=SEED),
        "Gradient Boosting": GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds, maxBins=bins,
                                          maxDepth=GBT_DEPTH, stepSize=GBT_STEP, seed=SEED),
    }


class DemandFits(dict):
    """{name: (scored test frame, metrics frame)}; ``residuals`` are those of the
    linear model on its training rows, with the features."""

    residuals: DataFrame


def fit_demand_models(frame: DataFrame, rounds: int | None = None) -> DemandFits:
    """Fit the three v1 regressors on the hashed 80 % of product-days.

    The assembled frame is cached once (product-day rows: bounded by calendar
    x catalog) and the three fits run as concurrent jobs.
    Returns {name: (scored test frame, metrics frame)}.
    """
    key = ["date", "product", "category"]
    data = random_split(frame, key).withColumn("label", F.col("units").cast("double"))
    data = sized(_assemble(V1_FEATURES).transform(data), key).cache()
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    # a bin for every product code, so that no two products are merged
    codes = data.agg(F.max("product_code")).first()[0] or 0
    ests = _regressors(rounds or GBT_ROUNDS, max(32, int(codes) + 1))
    models = in_parallel([lambda e=e: e.fit(train) for e in ests.values()])
    out = DemandFits()
    out.residuals = models[0].transform(train).select(*V1_FEATURES, (F.col("label") - F.col("prediction")).alias("residual"))
    for name, model in zip(ests, models):
        scored = model.transform(test).select(*key, F.col("label").alias("actual"),
                                              F.col("prediction").alias("predicted"))
        out[name] = (scored, FC.metrics(scored))
    return out


def comparison(results: dict) -> DataFrame:
    """Tall (model, metric, value) frame."""
    frames = []
    for name, (_, m) in results.items():
        frames.append(m.select(F.lit(name).alias("model"), F.expr(
            "stack(4, 'MAE', mae, 'RMSE', rmse, 'R2', r2, 'MAPE', mape) as (metric, value)")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def best_of(comp: DataFrame, metric: str, higher_is_better: bool, order: Sequence[str]) -> DataFrame:
    """Arg-max/min over models; ties go to the earlier model in ``order``."""
    pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    v = comp.where(F.col("metric") == metric)
    key = F.struct((F.col("value") if higher_is_better else -F.col("value")).alias("v"), (-pos).alias("p"))
    return v.agg(F.max_by("model", key).alias("best_model"),
                 F.max_by("value", key).alias("value")).withColumn("metric", F.lit(metric))


SAME_DAY = ("units", "unique_customers", "transactions")


def tuned_features(columns: Sequence[str]) -> list[str]:
    """What the tuned booster may see: nothing of the day it predicts."""
    return [c for c in columns if c not in ("date", "revenue", *SAME_DAY)]


def tuned_gbt(daily_feats: DataFrame, trials: int | None = None, rounds: tuple[int, int] | None = None, seed: int = SEED):
    """Random search over boosting parameters on the chronological split.

    The parameters are drawn on the driver (numbers only); all trials are fitted
    together, a task each (``boosting``).  Rows and columns are sampled per tree.
    Returns (trials frame, scored validation frame of the best trial).
    """
    trials, rounds = trials or TUNING_TRIALS, rounds or TUNING_ROUNDS
    daily_feats = materialized(daily_feats)
    w = Window.orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    data = daily_feats.select("*", F.row_number().over(w).alias("_i"), n.alias("_n")) \
        .withColumn("split", F.when(F.col("_i") <= F.floor(F.col("_n") * 0.8), "train").otherwise("validation")) \
        .withColumn("label", F.col("revenue").cast("double"))
    rng = random.Random(seed)
    params = []
    for t in range(trials):
        params.append({
            "trial": t,
            "max_iter": rng.randint(*rounds),
            "max_depth": rng.randint(*TUNING_DEPTH),
            "step_size": round(rng.uniform(*TUNING_STEP), 4),
            "subsampling_rate": round(rng.uniform(*TUNING_SAMPLE), 4),
            "colsample": round(rng.uniform(*TUNING_SAMPLE), 4),
        })
    scored = materialized(BO.boost_trials(data, tuned_features(daily_feats.columns), params, seed).where("split = 'validation'"))
    drawn = daily_feats.sparkSession.createDataFrame([tuple(p.values()) for p in params], BO.PARAMS)
    rated = drawn.join(F.broadcast(FC.metrics(scored, by=["trial"])), "trial")  # a row per trial
    # ties: the earlier trial
    best = rated.agg(F.min(F.struct("rmse", "trial"))["trial"].alias("best_trial"))
    trials_df = materialized(rated.crossJoin(F.broadcast(best)).select(
        *drawn.columns, "rmse", "mae", "mape", (F.col("trial") == F.col("best_trial")).alias("is_best")))
    winner = trials_df.where("is_best").select("trial")
    return trials_df, scored.join(F.broadcast(winner), "trial").select("date", "actual", "predicted")


def ar30_forecast(sequences: DataFrame, train_fraction: float = 0.8, n: int = 30):
    """AR(30): the 30 previous revenues as regressors, chronological split.

    Re-aims the reference's 30-step sequence network as a linear
    autoregression over the same windows.  Returns (scored validation, metrics).
    """
    sequences = materialized(sequences)
    cols = [F.col("window")[i].alias(f"lag_{n - i}") for i in range(n)]
    w = Window.orderBy("date")
    cnt = F.count(F.lit(1)).over(Window.partitionBy())
    data = sequences.select("date", F.col("target").alias("label"), *cols,
                            F.row_number().over(w).alias("_i"), cnt.alias("_n"))
    data = sized(_assemble([f"lag_{k}" for k in range(1, n + 1)]).transform(data), ["date"]).cache()
    train = data.where(F.col("_i") <= F.floor(F.col("_n") * train_fraction))
    val = data.where(F.col("_i") > F.floor(F.col("_n") * train_fraction))
    model = LinearRegression(featuresCol="features", labelCol="label", solver="normal", regParam=0.0).fit(train)
    scored = model.transform(val).select("date", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return scored, FC.metrics(scored)


# ---------------------------------------------------------------- forecast reports

def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Predicted revenue for the next 30 and the next 90 days."""
    fut = forecast.where(F.col("is_future"))
    first = fut.agg(F.min("date").alias("_f"))
    f = fut.crossJoin(F.broadcast(first)).withColumn("_h", F.datediff("date", "_f"))
    return f.agg(
        F.sum(F.when(F.col("_h") < 30, F.col("yhat"))).alias("next_30_days"),
        F.sum("yhat").alias("next_90_days"),
        F.count(F.lit(1)).alias("horizon_days"),
    )


def actual_vs_forecast(daily: DataFrame, forecast: DataFrame, n: int = HORIZON) -> DataFrame:
    actual = daily.orderBy(F.desc("date")).limit(n).select("date", F.lit("actual").alias("series"),
                                                           F.col("revenue").alias("value"))
    fc = forecast.where(F.col("is_future")).select("date", F.lit("forecast").alias("series"),
                                                   F.col("yhat").alias("value"))
    return actual.unionByName(fc)


# ---------------------------------------------------------------- segmentation

RFM_FEATURES = ("recency", "frequency", "monetary", "avg_order_value")


def _scaled(base: DataFrame) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(RFM_FEATURES), outputCol="raw").transform(
        base.select("customer_id", *[F.col(c).cast("double") for c in RFM_FEATURES]))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
    return scaler.transform(assembled)


def kmeans_segments(base: DataFrame, k: int = KMEANS_K, restarts: int = KMEANS_RESTARTS) -> CL.Fit:
    """Best of ``restarts`` exact K-means fits (``clustering``); segments 0..k-1
    by descending mean monetary."""
    return CL.kmeans(materialized(base), k, restarts, KMEANS_ROUNDS, SEED)


def kmeans_profiles(seg: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return seg.groupBy("segment").agg(
        *[F.round(F.avg(c), 2).alias(c) for c in RFM_FEATURES], n.alias("customers"))


def rfm_pca(base: DataFrame, k: int = PCA_K):
    """2-D projection of the standardised RFM features.

    The sign of each component is fixed so that its largest loading is
    positive.  Returns (projection, loadings as rows).
    """
    data = sized(_scaled(materialized(base)), ["customer_id"]).cache()
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(data)
    pc = model.pc.toArray()  # features x k, small
    signs = []
    for j in range(k):
        col = pc[:, j]
        idx = max(range(len(col)), key=lambda i: abs(col[i]))
        signs.append(1.0 if col[idx] >= 0 else -1.0)
    arr = vector_to_array("pcs")
    proj = model.transform(data).select(
        "customer_id", *[(arr[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])
    spark = base.sparkSession
    rows = [(RFM_FEATURES[i], *[float(pc[i, j] * signs[j]) for j in range(k)]) for i in range(len(RFM_FEATURES))]
    loadings = spark.createDataFrame(rows, "feature string, " + ", ".join(f"pc{j + 1} double" for j in range(k)))
    return proj, loadings
