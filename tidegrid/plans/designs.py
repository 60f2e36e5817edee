"""Queries: regressors and design matrices of the event stream. A session is a kind of event, a condition a third of the users, time counts hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, models
from ..sources.tables import epoch_us, table
from .registry import query
from .sampling import rounded

#: Hours of the first event's day since 1970; scans every two hours.
DAY0, TR, N = 473352, 2.0, 360
STEP = "(2.0 / 16)"
STREAM = f"ev as (select event_type as session, 'u' || user_id % 3 as condition, epoch_us(ts) / 3.6e9 - {DAY0} as onset, (user_id % 4)::double as duration, value as amplitude from events)"


def _grid(ov: int, block: bool) -> str:
    """The boxcar of each session and condition on the fine grid, written out point by point."""
    dt, last = f"({TR} / {ov})", (int(N * TR) + 24) * ov // 2
    step = lambda t: f"least(greatest(ceil(({t} + 24) / {dt} - 1e-9), 0), {last})::bigint"
    long = "duration" if block else "0"
    return f"""st as (select *, {step('onset')} as j, {step(f'onset + {long}')} as e from ev), sw as (select *, case when e = j and e < {last} then e + 1 else e end as o from st),
    dl as (select session, condition, j, arg_max(amplitude, struct_pack(a := onset, b := {long}, c := amplitude)) as d from sw group by 1, 2, 3 union all select session, condition, o, -arg_max(amplitude, struct_pack(a := onset, b := {long}, c := amplitude)) from sw group by 1, 2, 3),
    pt as (select session, condition, j, coalesce(sum(d), 0) as d from (select distinct session, condition from ev) cross join range({last + 1}) t(j) left join dl using (session, condition, j) group by 1, 2, 3),
    bx as (select session, condition, j, sum(d) over (partition by session, condition order by j) as r from pt)"""


def _response(name: str, shift: str = "0", delay: str = "6 / 0.9", start: str = "0.9", under: str = "12 / 0.9", u_start: str = "0.9", ratio: str = "0.35") -> str:
    """A kernel of 256 points over 32 hours, summing to one."""
    pdf = lambda a, s: f"case when t > {STEP} / {s} then exp(({a} - 1) * ln(t - {STEP} / {s}) - (t - {STEP} / {s}) - lgamma({a})) else 0 end"
    return f"{name}0 as (select i, {pdf(delay, start)} - {ratio} * {pdf(under, u_start)} as h from (select i, i * 32.0::double / 255 - {shift} / {STEP} as t from range(256) r(i))), {name} as (select i, h / (select sum(h) from {name}0) as h from {name}0)"


def _convolved(kernel: str, value: str, ov: int = 16) -> str:
    return f"{value} as (select session, condition, scan, sum(r * h) as {value} from range({N}) s(scan) join {kernel} on true join bx on bx.j = {12 * ov} + scan * {ov} - i group by 1, 2, 3)"


CANONICAL = _response("k0")
SPM = dict(delay="6.0", start="1.0", under="16.0", u_start="1.0", ratio="0.167")
DERIVED = f"{_response('ka', **SPM)}, {_response('kb', shift='0.1', **SPM)}, {_response('kc', **(SPM | dict(delay='6 / 1.01', start='1.01')))}, kd as (select i, (kb.h - ka.h) / 0.1 as h from ka join kb using (i)), ke as (select i, (kc.h - ka.h) / 0.01 as h from ka join kc using (i))"
ORTHOGONAL = """al as (select * from va join vd using (session, condition, scan) join ve using (session, condition, scan)),
    g1 as (select session, condition, sum(vd * va) / sum(va * va) as b from al group by 1, 2), o1 as (select al.*, vd - b * va as wd from al join g1 using (session, condition)),
    g2 as (select session, condition, sum(ve * va) / sum(va * va) as b, sum(ve * wd) / sum(wd * wd) as c from o1 group by 1, 2), o2 as (select o1.*, ve - b * va - c * wd as we from o1 join g2 using (session, condition))"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("session"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("condition"), (epoch_us("ts") / 3.6e9 - DAY0).alias("onset"), (F.col("user_id") % 4).cast("double").alias("duration"), F.col("value").alias("amplitude"))


def sessions(e: DataFrame) -> DataFrame:
    return e.select("session").distinct().withColumn("n", F.lit(N))


@query("event_regressors", f"with {STREAM}, {_grid(16, False)}, {CANONICAL}, {_convolved('k0', 'v')} select session, scan, condition as name, round(v, 6) as value from v")
def event_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a duration under the canonical response."""
    e = stream(spark, sf_dir)
    return rounded(events.regressors(e, sessions(e), TR, amplitude="amplitude"), "value", places=6)


@query("block_regressors", f"with {STREAM}, {_grid(16, True)}, {DERIVED}, {_convolved('ka', 'va')}, {_convolved('kd', 'vd')}, {_convolved('ke', 've')}, {ORTHOGONAL} select session, scan, condition as name, round(va, 5) as value from o2 union all select session, scan, condition || '_derivative', round(wd, 5) from o2 union all select session, scan, condition || '_dispersion', round(we, 5) from o2")
def block_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks under the response with its time and dispersion derivatives, each orthogonal to those before it."""
    e = stream(spark, sf_dir)
    return rounded(events.regressors(e, sessions(e), TR, "spm_time_dispersion", duration="duration", amplitude="amplitude"), "value", places=5)


@query("fir_regressors", f"with {STREAM}, {_grid(1, False)} select session, scan, condition || '_delay_' || delay as name, round(coalesce(sum(r), 0), 6) as value from range({N}) s(scan) cross join (values (0), (1), (3)) d(delay) join bx on bx.j = 12 + scan - delay group by 1, 2, condition, delay")
def fir_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir)
    return rounded(events.regressors(e, sessions(e), TR, "fir", (0, 1, 3), amplitude="amplitude"), "value", places=6)


WIDE = f"w as (select session, scan, coalesce(max(v) filter (condition = 'u0'), 0) as u0, coalesce(max(v) filter (condition = 'u1'), 0) as u1, coalesce(max(v) filter (condition = 'u2'), 0) as u2 from (select distinct session from ev) cross join range({N}) s(scan) left join v using (session, scan) group by 1, 2)"


@query("design_matrix_cosine", f"with {STREAM}, {_grid(16, False)}, {CANONICAL}, {_convolved('k0', 'v')}, {WIDE} select session, scan, round(u0, 6) as u0, round(u1, 6) as u1, round(u2, 6) as u2, {', '.join(f'round(sqrt(2.0 / {N}) * cos(pi() / {N} * (scan + 0.5) * {k}), 6) as drift_{k}' for k in range(1, 6))}, 1.0::double as constant from w")
def design_matrix_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of 240 hours and more make six drifts."""
    e = stream(spark, sf_dir)
    made = events.design_matrix(e, e, TR, N, ["u0", "u1", "u2"], cut=240.0, amplitude="amplitude")
    return rounded(made, *[c for c in made.columns if c not in ("session", "scan", "constant")], places=6)


@query("event_design_fit", f"""with {STREAM}, {_grid(16, False)}, {CANONICAL}, {_convolved('k0', 'v')}, {WIDE}, y as (select session, floor(onset / 2)::bigint as scan, count(*)::double as y from ev where onset >= 0 group by 1, 2),
    t as (select session, scan, u0, scan / {N - 1}.0::double - 0.5 as t, coalesce(y, 0) as y from w left join y using (session, scan)), s as (select session, count(*) as n, regr_sxy(u0, t) as ut, regr_sxx(t, u0) as uu, regr_sxx(u0, t) as tt, regr_sxy(y, u0) as uy, regr_sxy(y, t) as ty from t group by 1)
    select session, round((tt * uy - ut * ty) / (uu * tt - ut * ut), 6) as b_u0, round((uu * ty - ut * uy) / (uu * tt - ut * ut), 6) as b_drift from s""".replace("regr_sxy(u0, t)", "sum(u0 * t) - sum(u0) * sum(t) / count(*)").replace("regr_sxy(y, u0)", "sum(y * u0) - sum(y) * sum(u0) / count(*)").replace("regr_sxy(y, t)", "sum(y * t) - sum(y) * sum(t) / count(*)"))  # fmt: skip
def event_design_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events on the design of one condition, with a linear drift."""
    e = stream(spark, sf_dir)
    x = events.design_matrix(e, e, TR, N, ["u0"], drift="polynomial", amplitude="amplitude")
    y = e.where("onset >= 0").groupBy("session", F.floor(F.col("onset") / TR).alias("scan")).agg(F.count("*").cast("double").alias("y"))
    fits = models.fit(x.join(y, ["session", "scan"], "left").fillna(0.0, subset=["y"]), ["session"], ["u0", "drift_1", "constant"], "y")
    return rounded(fits.select("session", F.col("beta")[0].alias("b_u0"), F.col("beta")[1].alias("b_drift")), "b_u0", "b_drift", places=6)
