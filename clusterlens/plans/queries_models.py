"""Queries on feature series and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterlens.operators import features, models
from clusterlens.plans import demo, flows
from clusterlens.plans.catalog import query
from clusterlens.session import stage

_SERIES = """
kr AS (SELECT container_id, min(tick) AS a, max(tick) AS b FROM htick GROUP BY container_id HAVING count(DISTINCT tick) > 1),
xs AS (SELECT tick, container_id, count(*)::DOUBLE AS n, sum(value) AS s FROM htick GROUP BY ALL),
ser AS (SELECT h.tick, h.container_id, coalesce(xs.n, 0.0) AS x, h.memory AS y
  FROM hcell h JOIN kr ON h.container_id = kr.container_id AND h.tick BETWEEN a AND b
  LEFT JOIN xs ON xs.tick = h.tick AND xs.container_id = h.container_id
  WHERE h.container_id NOT LIKE '%000001')"""
_TRAINING = f"""{_SERIES},
num AS (SELECT 'store' AS source, x, y, row_number() OVER (ORDER BY tick, container_id) - 1 AS p, count(*) OVER () AS n FROM ser),
b AS (SELECT *, CASE WHEN n < 6 THEN 0 ELSE (n - 6) // 5 + 1 END AS last FROM num),
w AS (SELECT source, x, y, p, unnest(range(greatest(0, (p - 5) // 5), least(last, p // 5) + 1)) AS k FROM b),
train AS (SELECT source, k AS window_no, sum(x) AS x, max(y) / 1000000 AS y FROM w WHERE p >= k * 5 AND p < k * 5 + 6 GROUP BY ALL)"""


def _tables(spark, sf_dir):
    hourly = demo.stored_cells(spark, sf_dir, demo.HOUR)
    return hourly, demo.task_messages(spark, sf_dir, demo.HOUR)


def _series(spark, sf_dir, use_rate=False, tables=None):
    hourly, long = tables or _tables(spark, sf_dir)
    return features.aligned_series(hourly, long, "memory", "task", "count", use_rate=use_rate)


def _training(spark, sf_dir):
    hourly, long = _tables(spark, sf_dir)
    return flows.tasks_against_memory(hourly, long)


@query("prj10_worker_containers", "SELECT tick, container_id FROM hcell WHERE container_id NOT LIKE '%000001'")
def workers(spark, sf_dir):
    hourly = demo.sample_cells(spark, sf_dir, demo.HOUR)
    return features.worker_containers(hourly).select("tick", "container_id")


@query("fea1_series", f"WITH {_SERIES} SELECT tick, container_id, x, y FROM ser")
def series(spark, sf_dir):
    return _series(spark, sf_dir)


@query(
    "fea1_rate_series",
    f"""WITH {_SERIES} SELECT tick, container_id, x,
      y - coalesce(lag(y) OVER (PARTITION BY container_id ORDER BY tick), 0) AS y FROM ser""",
)
def rate_series(spark, sf_dir):
    return _series(spark, sf_dir, use_rate=True)


@query(
    "set1_union_sources",
    f"""WITH {_SERIES} SELECT 'count' AS source, tick, container_id, x, y FROM ser
    UNION ALL SELECT 'rate', tick, container_id, x,
      y - coalesce(lag(y) OVER (PARTITION BY container_id ORDER BY tick), 0) FROM ser""",
)
def union_sources(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    both = {"count": _series(spark, sf_dir, False, tables), "rate": _series(spark, sf_dir, True, tables)}
    return features.union_sources(both)


@query("fea2_training_set", f"WITH {_TRAINING} SELECT source, window_no, x, round(y, 6) AS y FROM train")
def training_set(spark, sf_dir):
    return _training(spark, sf_dir).withColumn("y", F.round("y", 6))


@query(
    "mod1_tasks_memory_fit",
    f"""WITH {_TRAINING} SELECT count(*)::BIGINT AS n, round(regr_slope(y, x), 6) AS slope,
      round(regr_intercept(y, x), 6) AS intercept FROM train""",
)
def tasks_memory_fit(spark, sf_dir):
    """Flagship: running tasks against peak memory, from raw records to the fitted line."""
    fit = models.linear_fit(_training(spark, sf_dir))
    return fit.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    "mod1_container_fits",
    """SELECT container_id, count(*)::BIGINT AS n, round(regr_slope(value, event_id), 9) AS slope,
      round(regr_intercept(value, event_id), 6) AS intercept FROM ev GROUP BY container_id""",
)
def container_fits(spark, sf_dir):
    fit = models.linear_fit(demo.events(spark, sf_dir), "event_id", "value", ["container_id"])
    return fit.select(
        "container_id", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept")
    )


@query(
    "mod2_fit_quality",
    """WITH f AS (SELECT container_id, regr_slope(value, event_id) AS b, regr_intercept(value, event_id) AS a,
        regr_r2(value, event_id) AS r2 FROM ev GROUP BY container_id)
    SELECT container_id, round(max(r2), 9) AS r2, round(avg((value - a - b * event_id) ^ 2), 4) AS mse
    FROM ev JOIN f USING (container_id) GROUP BY container_id""",
)
def fit_quality(spark, sf_dir):
    quality = models.fit_quality(demo.events(spark, sf_dir), "event_id", "value", ["container_id"])
    return quality.select("container_id", F.round("r2", 9).alias("r2"), F.round("mse", 4).alias("mse"))


@query(
    "mod3_band",
    """WITH f AS (SELECT container_id, regr_intercept(value, event_id) + 3 * regr_slope(value, event_id) AS y0,
        1.7291328 * stddev_samp(value) / sqrt(count(*)) AS half FROM ev GROUP BY container_id)
    SELECT container_id, round(y0, 6) AS y0, round(y0 - half, 6) AS low, round(y0 + half, 6) AS high FROM f""",
)
def band(spark, sf_dir):
    fit = models.linear_fit(demo.events(spark, sf_dir), "event_id", "value", ["container_id"])
    rows = models.interval(fit, 3.0, t=1.7291328)
    return rows.select("container_id", *[F.round(c, 6).alias(c) for c in ("y0", "low", "high")])


@query(
    "mod3_band_default",
    """WITH RECURSIVE f AS (SELECT container_id, count(*) AS n, regr_intercept(value, event_id) + 3 * regr_slope(value, event_id) AS y0,
        stddev_samp(value) / sqrt(count(*)) AS se FROM ev GROUP BY container_id HAVING count(*) > 2),
    deg AS (SELECT DISTINCT n, n - 2 AS v FROM f),
    term AS (SELECT n, v, k, v % 2 + 2 * k AS p, CASE WHEN v % 2 = 0
        THEN exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) ELSE sqrt(pi()) * exp(lgamma(k + 1) - lgamma(k + 1.5)) / 2 END AS w
      FROM (SELECT n, v, unnest(range(0, (v - v % 2) // 2)) AS k FROM deg)),
    ends AS (
      SELECT 0 AS step, n, v, 0.0::DOUBLE AS low, pi() / 2 AS high FROM deg
      UNION ALL
      SELECT step + 1, n, v, CASE WHEN area < 0.9 THEN mid ELSE low END, CASE WHEN area < 0.9 THEN high ELSE mid END
      FROM (SELECT step, e.n, e.v, low, high, (low + high) / 2 AS mid, CASE WHEN e.v % 2 = 0 THEN 1 ELSE 2 / pi() END
              * (CASE WHEN e.v % 2 = 0 THEN 0 ELSE (low + high) / 2 END
                 + sin((low + high) / 2) * coalesce(sum(w * pow(cos((low + high) / 2), p)), 0)) AS area
            FROM ends e LEFT JOIN term ON term.n = e.n WHERE step < 50 GROUP BY step, e.n, e.v, low, high)),
    q AS (SELECT n, sqrt(v) * tan((low + high) / 2) AS t FROM ends WHERE step = 50)
    SELECT container_id, round(y0, 4) AS y0, round(y0 - t * se, 4) AS low, round(y0 + t * se, 4) AS high FROM f JOIN q USING (n)""",
)
def band_default(spark, sf_dir):
    """Band by Student's quantile; the SQL form inverts the finite sums for whole degrees of freedom."""
    fit = models.linear_fit(demo.events(spark, sf_dir), "event_id", "value", ["container_id"])
    rows = models.interval(fit.where("n > 2"), 3.0)
    return rows.select("container_id", *[F.round(c, 4).alias(c) for c in ("y0", "low", "high")])


@query(
    "mod4_correlation",
    "SELECT container_id, round(corr(event_id, value), 9) AS corr FROM ev GROUP BY container_id",
)
def correlation(spark, sf_dir):
    rows = models.correlation(demo.events(spark, sf_dir), "event_id", "value", ["container_id"])
    return rows.select("container_id", F.round("corr", 9).alias("corr"))


_NEAR = "(x - x0) * (x - x0) + (y - y0) * (y - y0) <= (x - x1) * (x - x1) + (y - y1) * (y - y1)"


@query(
    "mod5_kmeans",
    f"""WITH RECURSIVE {_TRAINING},
    pt AS MATERIALIZED (SELECT source, window_no, x, y FROM train),
    mean AS (
      SELECT 0 AS step, (SELECT x FROM pt ORDER BY x, y LIMIT 1) AS x0, (SELECT y FROM pt ORDER BY x, y LIMIT 1) AS y0,
        (SELECT x FROM pt ORDER BY x DESC, y DESC LIMIT 1) AS x1, (SELECT y FROM pt ORDER BY x DESC, y DESC LIMIT 1) AS y1
      UNION ALL
      SELECT step + 1, coalesce(avg(x) FILTER (WHERE {_NEAR}), any_value(x0)), coalesce(avg(y) FILTER (WHERE {_NEAR}), any_value(y0)),
        coalesce(avg(x) FILTER (WHERE NOT ({_NEAR})), any_value(x1)), coalesce(avg(y) FILTER (WHERE NOT ({_NEAR})), any_value(y1))
      FROM mean, pt WHERE step < 100 GROUP BY step),
    c AS (SELECT * FROM mean WHERE step = 100)
    SELECT source, window_no, x, round(y, 6) AS y,
      CASE WHEN ({_NEAR}) = ((x0, y0) <= (x1, y1)) THEN 0 ELSE 1 END AS cluster FROM pt, c""",
)
def kmeans(spark, sf_dir):
    """Two clusters of (tasks, memory) windows."""
    rows = models.kmeans(stage(_training(spark, sf_dir)))
    return rows.select("source", "window_no", "x", F.round("y", 6).alias("y"), "cluster")
