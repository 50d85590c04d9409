"""Queries of resampling, econometrics, portfolios, retrieval and learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.text_keys import hash_key
from tapewright.operators import graph, hierarchy, learning, linear, portfolio, resample, retrieval
from tapewright.operators.hierarchy import hierarchy_edges
from tapewright.plans.base import BARS, W
from tapewright.plans.measures import returns
from tapewright.plans.problem_sql import _EDGES
from tapewright.runtime import cut, table

QUERIES, SQL = {}, {}
_R = f"WITH {BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM x), v AS (SELECT * FROM r WHERE ret IS NOT NULL)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query()
def x_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _r(resample.bootstrap_interval(returns(spark, d), ["series"], "ret", "bar_id"), 10)


@query()
def x_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _r(resample.block_bootstrap_interval(returns(spark, d).drop("rn"), ["series"], "ret", "ts", ["bar_id"], 20), 10)


@query()
def x_simulations(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """Terminal distributions of four processes, 4,000 paths each."""
    out = None
    for m in ("gbm", "heston", "ou", "jump"):
        s = resample.simulate(spark, m, 4_000, 60).agg(F.avg("terminal").alias("mean"), F.stddev_samp("terminal").alias("std"), F.percentile("terminal", F.lit(0.05)).alias("p5"), F.percentile("terminal", F.lit(0.95)).alias("p95")).withColumn("model", F.lit(m))
        out = s if out is None else out.union(s)
    return _r(out, 6)


@query()
def x_growth(spark: SparkSession, d: str) -> DataFrame:
    """Resampled growth of each series: quantiles over 1,000 replicates."""
    g = resample.resampled_terminals(returns(spark, d), ["series"], "ret", "bar_id")
    return _r(g.groupBy("series").agg(*[F.percentile("growth", F.lit(q)).alias(n) for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))]), 8)


@query()
def x_attacks(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).withColumns({"asset": F.split("series", r"\|")[1], "regime": F.when(F.hour("ts") < 7, "asia").when(F.hour("ts") < 13, "london").otherwise("new york")})
    return _r(resample.attacks(r, "ret", "asset", "regime", F.pmod(F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)), F.lit(10)), "bar_id", 1000), 10)


@query(f"""{_R}, q AS (SELECT series, ret AS y, ln(1 + volume) AS a, (high - low) / close AS b FROM v) SELECT series, 'intercept' AS term, count(*) AS rows, round(regr_intercept(y, b), 8) AS coefficient, round(regr_r2(y, b), 6) AS r2 FROM q GROUP BY series
 UNION ALL SELECT series, 'b', count(*), round(regr_slope(y, b), 6), round(regr_r2(y, b), 6) FROM q GROUP BY series""")
def x_regression(spark: SparkSession, d: str) -> DataFrame:
    x = returns(spark, d).withColumn("b", (F.col("high") - F.col("low")) / F.col("close"))
    r = linear.regression(x, ["series"], "ret", ["b"])
    return r.select("series", "term", "rows", F.when(F.col("term") == "b", F.round("coefficient", 6)).otherwise(F.round("coefficient", 8)).alias("coefficient"), F.round("r2", 6).alias("r2"))


@query()
def x_multiple_regression(spark: SparkSession, d: str) -> DataFrame:
    x = returns(spark, d).withColumns({"a": F.log1p("volume"), "b": (F.col("high") - F.col("low")) / F.col("close"), "b2": F.pow((F.col("high") - F.col("low")) / F.col("close"), F.lit(2.0))})
    x = cut(x.select("series", "ret", "a", "b", "b2"))
    r = linear.regression(x, ["series"], "ret", ["a", "b", "b2"]).join(linear.vif(x, ["series"], ["a", "b", "b2"]), ["series", "term"], "left")
    return r.select("series", "term", *[F.round(c, n).alias(c) for c, n in (("coefficient", 5), ("se", 5), ("t", 4), ("r2", 5), ("vif", 3))], "rows")


@query()
def x_unit_root(spark: SparkSession, d: str) -> DataFrame:
    """Augmented Dickey-Fuller of closes and of returns."""
    r = returns(spark, d)
    return _r(linear.dickey_fuller(r, ["series"], "close").withColumn("of", F.lit("close")).union(linear.dickey_fuller(r, ["series"], "ret").withColumn("of", F.lit("ret"))), 4)


@query()
def x_granger(spark: SparkSession, d: str) -> DataFrame:
    return _r(linear.granger(returns(spark, d), ["series"], "volume", "ret", 2).drop("p"), 5)


@query()
def x_autoregression(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    ar = linear.autoregression(r, ["series"], "ret", 2).withColumn("target", F.lit("ar:ret"))
    return _r(ar.union(linear.vector_autoregression(r, ["series"], ["ret", "volume"])).drop("p"), 5)


@query()
def x_autocorrelations(spark: SparkSession, d: str) -> DataFrame:
    a = linear.autocorrelations(returns(spark, d), ["series"], "ret", 10)
    return a.select("series", "lag", F.round("acf", 6).alias("acf"), F.round("ljung_box", 5).alias("ljung_box"))


@query()
def x_partial_autocorrelations(spark: SparkSession, d: str) -> DataFrame:
    """Partial autocorrelations, and the p of the Ljung-Box statistics up to each lag."""
    return _r(linear.autocorrelations(returns(spark, d), ["series"], "ret", 10).select("series", "lag", "pacf", "p"), 6)


@query(f"""{_R}, k AS (SELECT unnest(range(-5, 6)) AS lag), j AS (SELECT a.series, k.lag, corr(a.ret, b.volume) AS c FROM v a JOIN k ON true JOIN v b ON b.series = a.series AND b.rn = a.rn + k.lag GROUP BY ALL) SELECT series, CAST(lag AS INTEGER) AS lag, round(c, 6) AS corr FROM j""")
def x_cross_lags(spark: SparkSession, d: str) -> DataFrame:
    return _r(linear.cross_lags(returns(spark, d), ["series"], "ret", "volume", 5), 6)


def _daily_returns(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    return r.groupBy(F.split("series", r"\|")[1].alias("asset"), F.to_date("ts").alias("day")).agg(F.sum("ret").alias("ret"))


@query(f"""{_R}, p AS (SELECT split_part(series, '|', 2) AS asset, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day, sum(ret) AS ret FROM v GROUP BY ALL)
SELECT a.asset AS a, b.asset AS b, count(*) AS n, round(covar_samp(a.ret, b.ret), 9) AS cov FROM p a JOIN p b ON a.day = b.day AND b.asset >= a.asset GROUP BY ALL HAVING count(*) > 1""")
def x_covariance(spark: SparkSession, d: str) -> DataFrame:
    c = portfolio.covariance_pairs(_daily_returns(spark, d), "asset", "day", "ret").where("n > 1")
    return c.select("a", "b", "n", F.round("cov", 9).alias("cov"))


@query()
def x_portfolios(spark: SparkSession, d: str) -> DataFrame:
    """Least-variance and largest-Sharpe weights, and each asset's share of risk."""
    names, mu, cov = portfolio.moments(_daily_returns(spark, d), "asset", "day", "ret")
    rows = []
    for kind, w in (("minimum_variance", portfolio.minimum_variance(cov)), ("maximum_sharpe", portfolio.maximum_sharpe(mu, cov))):
        rows += [(kind, n, float(np.round(a, 6)), float(np.round(b, 6))) for n, a, b in zip(names, w, portfolio.risk_contributions(w, cov))]
    return spark.createDataFrame(rows, "portfolio string, asset string, weight double, risk double")


@query()
def x_frontier(spark: SparkSession, d: str) -> DataFrame:
    _, mu, cov = portfolio.moments(_daily_returns(spark, d), "asset", "day", "ret")
    return _r(spark.createDataFrame([(i, m, s) for i, (m, s, _) in enumerate(portfolio.frontier(mu, cov))], "point int, mean double, deviation double"), 8)


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS dist FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS rank FROM p) SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS distance FROM k WHERE rank <= 5""")
def x_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return _r(retrieval.nearest_vectors(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding"), 6)


@query("""WITH t AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), ['weekly', 'average', 'backtest', 'slippage'])) / 4.0 AS score FROM documents WHERE text IS NOT NULL) SELECT doc_id AS id, score FROM t WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def x_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A top-ten report by word overlap."""
    return retrieval.token_overlap(table(spark, d, "documents"), "weekly average backtest slippage", "doc_id", "text")


@query(f"""WITH {_EDGES}, u AS (SELECT p AS a, c AS b FROM e UNION SELECT c, p FROM e) SELECT a AS node, count(DISTINCT b) AS neighbours FROM u GROUP BY a""")
def x_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Undirected neighbours of each artifact."""
    e = hierarchy_edges(table(spark, d, "lineage"))
    u = e.select(F.col("parent").alias("node"), F.col("child").alias("other")).union(e.select(F.col("child").alias("node"), F.col("parent").alias("other"))).distinct()
    return u.groupBy("node").agg(F.count("other").alias("neighbours"))


@query("""WITH n AS (SELECT regexp_replace(lower(regexp_replace(artifact_hash, '\\s+', '', 'g')), '^sha256:', '') AS h, artifact_type FROM evidence),
 l AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(parent_hash, '\\s+', '', 'g')), '^sha256:', '') AS p, regexp_replace(lower(regexp_replace(child_hash, '\\s+', '', 'g')), '^sha256:', '') AS c FROM lineage WHERE parent_hash IS NOT NULL AND child_hash IS NOT NULL)
 SELECT n.artifact_type AS child_type, coalesce(m.artifact_type, '?') AS parent_type, count(*) AS edges FROM l JOIN n ON n.h = l.c LEFT JOIN n m ON m.h = l.p GROUP BY ALL""")
def x_lineage_types(spark: SparkSession, d: str) -> DataFrame:
    """Edges by the types of their ends; parents that the evidence lacks are '?'."""
    ev = table(spark, d, "evidence").select(hash_key("artifact_hash").alias("h"), "artifact_type")
    ln = table(spark, d, "lineage").where("parent_hash is not null and child_hash is not null").select(hash_key("parent_hash").alias("p"), hash_key("child_hash").alias("c")).distinct()
    j = ln.join(ev.select(F.col("h").alias("c"), F.col("artifact_type").alias("child_type")), "c").join(ev.select(F.col("h").alias("p"), F.col("artifact_type").alias("parent_type")), "p", "left")
    return j.groupBy("child_type", F.coalesce("parent_type", F.lit("?")).alias("parent_type")).agg(F.count("*").alias("edges"))


@query()
def x_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Direction of the next row: logistic model and trees trained on the first 70 %, measured on the rest against the base rate."""
    return _r(learning.evaluate_models(learning.dataset(returns(spark, d)), ["x_ret", "x_range", "x_volume"]), 6)


@query()
def x_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Expanding refits of the logistic model over four folds."""
    return _r(learning.walk_forward(learning.dataset(returns(spark, d)), ["x_ret", "x_range", "x_volume"], folds=4), 6)


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT p AS n FROM e WHERE p NOT IN (SELECT c FROM e)), r AS (SELECT n AS start, n AS node, 0 AS distance FROM s UNION SELECT r.start, e.c, r.distance + 1 FROM r JOIN e ON e.p = r.node WHERE r.distance < 5)
SELECT start, node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY ALL""")
def x_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """What every root reaches within five steps, with distances."""
    e = hierarchy_edges(table(spark, d, "lineage"))
    roots = e.select(F.col("parent").alias("start")).distinct().join(e.select(F.col("child").alias("start")).distinct(), "start", "left_anti")
    return graph.shortest_paths(e, roots, hops=5).select("start", "node", "distance")


@query()
def x_all_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """What every root reaches, however many steps away, with distances."""
    return hierarchy.shortest_from_roots(table(spark, d, "lineage")).select("start", "node", "distance")


@query()
def x_undirected_paths(spark: SparkSession, d: str) -> DataFrame:
    """A shortest path from every root to every artifact joined to it by edges of either direction."""
    return hierarchy.shortest_from_roots(table(spark, d, "lineage"), directed=False).withColumn("path", F.array_join("path", ">"))
