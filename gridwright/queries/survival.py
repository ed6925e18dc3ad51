"""Survival metrics over events: time to the user's next event, observed when there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import survival as srv
from gridwright.operators.sequence import with_next
from gridwright.queries.base import query, rounded, table

# hours to the next event of the user (or to the end of the month), risk from the value
SURV = """(SELECT event_id AS key, coalesce(epoch_us(lead(ts) OVER w), epoch_us(TIMESTAMP '2024-02-01')) / 3.6e9 - epoch_us(ts) / 3.6e9 AS "time",
  (lead(ts) OVER w IS NOT NULL)::INT AS event, value / 100 AS risk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def surv(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", us.alias("us"))
    t = with_next(t, ["user_id"], ["ts", "event_id"], ["us"])
    end = F.unix_micros(F.lit("2024-02-01").cast("timestamp_ntz").cast("timestamp"))
    return t.select(
        F.col("event_id").alias("key"), (F.coalesce("us_next", end) / 3.6e9 - F.col("us") / 3.6e9).alias("time"),
        F.col("us_next").isNotNull().cast("int").alias("event"), (F.col("value") / 100).alias("risk"),
    )


@query(
    "ms1_concordance",
    f"""WITH s AS MATERIALIZED {SURV} SELECT round(count(*) FILTER (a.risk > b.risk)::DOUBLE / count(*), 6) AS c_index FROM s a JOIN s b ON a.event = 1 AND a.time < b.time""",
)
def ms1(spark, sf):
    return rounded(srv.concordance(surv(spark, sf)))


@query(
    "ms2_cox",
    f"""SELECT round(-sum((risk - ln(rs + 1e-8)) * event) / (sum(event) + 1e-8), 6) AS cox_loss FROM (
    SELECT risk, event, sum(exp(risk)) OVER (ORDER BY "time" DESC, key ROWS UNBOUNDED PRECEDING) AS rs FROM {SURV})""",
)
def ms2(spark, sf):
    return rounded(srv.cox_loss(surv(spark, sf)))


_HAZ = "list_transform(range(20), lambda i: 0.02 + 0.01 * (i % 5) + least(value, 100) / 2000)"
_CURVE = f"(SELECT event_id, list_transform(range(1, 21), lambda j: list_product(list_transform(({_HAZ})[1:j], lambda h: 1 - h))) AS s FROM events)"


def hazards(df, value):
    return df.withColumn(
        "hazard", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.lit(0.02) + 0.01 * (i % 5) + F.least(value, F.lit(100.0)) / 2000)
    )


@query("ms3_survival_curve", f"SELECT event_id, round(s[1], 6) AS first, round(s[10], 6) AS middle, round(s[20], 6) AS last FROM {_CURVE}")
def ms3(spark, sf):
    out = hazards(table(spark, sf, "events"), F.col("value")).select("event_id", srv.survival_curve(F.col("hazard")).alias("s"))
    return rounded(out.select("event_id", F.col("s")[0].alias("first"), F.col("s")[9].alias("middle"), F.col("s")[19].alias("last")))


_H = f"(SELECT key, \"time\", event, {_HAZ.replace('value', '(risk * 100)')} AS h FROM {SURV})"


@query(
    "ms4_discrete_nll",
    f"""WITH s AS MATERIALIZED {_H}, b AS (SELECT *, least(greatest(trunc("time" / (SELECT max("time") FROM s) * 20)::INT, 0), 19) AS b FROM s)
    SELECT round(avg(list_sum(list_transform(h, lambda x, i: CASE WHEN i - 1 <= b - event THEN -ln(1 - x + 1e-8) ELSE 0 END)) + CASE WHEN event = 1 THEN -ln(h[b + 1] + 1e-8) ELSE 0 END), 6) AS nll FROM b""",
)
def ms4(spark, sf):
    return rounded(srv.discrete_nll(hazards(surv(spark, sf), F.col("risk") * 100), "hazard", 20))


def _params(df):
    return df.select(
        "*", (F.lit(1.0) + F.col("risk") / 10).alias("shape"), (F.lit(10.0) + F.col("risk")).alias("scale"), (F.lit(0.1) + F.col("risk") / 100).alias("rate"),
        (F.lit(2.0) + F.col("risk") / 10).alias("mu"), F.lit(1.0).alias("sigma"),
    )


_PAR = f"(SELECT *, 1 + risk / 10 AS shape, 10 + risk AS scale, 0.1 + risk / 100 AS rate FROM {SURV})"


@query(
    "ms5_parametric_nll",
    f"""SELECT round(-avg(CASE WHEN event = 1 THEN ln(shape) - ln(scale) + (shape - 1) * (ln("time") - ln(scale)) ELSE 0 END - pow("time" / scale, shape)), 6) AS weibull,
    round(-avg(CASE WHEN event = 1 THEN ln(rate) ELSE 0 END - rate * "time"), 6) AS exponential FROM {_PAR}""",
)
def ms5(spark, sf):
    df = _params(surv(spark, sf))
    a = srv.parametric_nll(df, "weibull").select(F.col("nll").alias("weibull"), F.lit(1).alias("k"))
    b = srv.parametric_nll(df, "exponential").select(F.col("nll").alias("exponential"), F.lit(1).alias("k"))
    return rounded(a.join(b, "k").drop("k"))


_ERFC = """CASE WHEN abs(x) < 1 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(40), lambda n: pow(-1, n) * pow(x, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))
  ELSE CASE WHEN x < 0 THEN 2.0 ELSE 0.0 END + sign(x) * exp(-x * x) / sqrt(pi()) / list_reduce(list_prepend(abs(x), list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda a, k: abs(x) + k / 2 / a) END"""


@query(
    "ms5_log_normal",
    f"""SELECT round(-avg(CASE WHEN event = 1 THEN -ln("time") - 0.5 * ln(2 * pi()) - x * x ELSE ln(0.5 * ({_ERFC}) + 1e-8) END), 6) AS nll
    FROM (SELECT *, (ln("time" + 1e-8) - (2 + risk / 10)) / sqrt(2) AS x FROM {SURV})""",
)
def ms5_log_normal(spark, sf):
    return rounded(srv.parametric_nll(_params(surv(spark, sf)), "log_normal"))


@query(
    "ms5_survival_grid",
    f"""SELECT key, round(t, 6) AS t, round(exp(-pow(t / scale, shape)), 6) AS survival FROM {_PAR}, (SELECT unnest(range(5)) * (50.0::DOUBLE / 4) AS t)""",
)
def ms5_grid(spark, sf):
    return rounded(srv.parametric_survival(_params(surv(spark, sf)), "weibull", 50.0, 5).select("key", "t", "survival"))


@query(
    "ms6_brier",
    f"""WITH s AS MATERIALIZED {_H} SELECT round(avg(pow(list_product(list_transform(h[1:11], lambda x: 1 - x)) - ("time" > (SELECT quantile_cont("time", 0.5) FROM s))::INT::DOUBLE, 2)), 6) AS brier FROM s""",
)
def ms6(spark, sf):
    df = hazards(surv(spark, sf), F.col("risk") * 100)
    return rounded(srv.brier(df.withColumn("curve", srv.survival_curve(F.col("hazard"))), "curve", 20))
