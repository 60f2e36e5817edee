"""Event designs: onsets of conditions to regressors at scan times, through response kernels on a finer grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import design
from ..functions.design import gamma_difference_kernel

#: Seconds of a response.
LENGTH = 32.0
#: Steps in which the derivatives of a response are taken: of its onset, of its dispersion.
ONSET_STEP, DISPERSION_STEP = 0.1, 0.01
#: Shapes of the two responses.
SPM: dict[str, float] = {}
CANONICAL = {"undershoot": 12.0, "dispersion": 0.9, "u_dispersion": 0.9, "ratio": 0.35}
#: Suffixes of a condition's regressors.
SUFFIXES = {
    "canonical": [""], "canonical with derivative": ["", "_derivative"], "spm": [""], "spm_time": ["", "_derivative"], "spm_time_dispersion": ["", "_derivative", "_dispersion"],
}


def suffixes(model: str, delays: Sequence[int] = (0,)) -> list[str]:
    if model == "fir":
        return [f"_delay_{d}" for d in delays]
    if model not in SUFFIXES:
        raise ValueError(f"unknown response model {model!r}")
    return SUFFIXES[model]


def kernels(model: str, tr: float, oversampling: int = 16, delays: Sequence[int] = (0,)) -> list[np.ndarray]:
    """The kernels of a model on a grid of tr / oversampling: LENGTH seconds of a response and its derivatives, or a box for each delay (in grid steps of whole scans)."""
    if model == "fir":
        return [np.concatenate([np.zeros(d * oversampling), np.ones(oversampling)]) for d in delays]
    shape = CANONICAL if model.startswith("canonical") else SPM
    made = lambda onset=0.0, **k: gamma_difference_kernel(tr, oversampling, LENGTH, onset, **(shape | k))
    out = [made()]
    if len(suffixes(model)) > 1:
        out.append((made(ONSET_STEP) - out[0]) / ONSET_STEP)
    if len(suffixes(model)) > 2:
        out.append((made(dispersion=1 + DISPERSION_STEP) - out[0]) / DISPERSION_STEP)
    return out


def orthogonalized(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with each column less its projection on those before it, within each unit: one aggregate of products, then a join of one row a unit."""
    by, k = list(by), len(columns)
    if k < 2:
        return df
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.groupBy(*by).agg(F.array(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])) for i, j in pairs]).alias("__g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(k)
        for batch in batches:
            out = []
            for g in batch.column(len(by)).to_pylist():
                full = np.zeros((k, k))
                full[upper] = g
                full = full + np.triu(full, 1).T
                t = np.eye(k)
                for i in range(1, k):
                    # rows of t make the orthogonal columns from the given ones
                    for j in range(i):
                        size = t[j] @ full @ t[j]
                        t[i] -= (t[i] @ full @ t[j]) / size * t[j] if size > 0 else 0
                out.append(t.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, pa.list_(pa.list_(pa.float64())))], [*by, "__t"])

    schema = StructType([*[sums.schema[c] for c in by], StructField("__t", ArrayType(ArrayType(DoubleType())))])
    joined = df.join(sums.mapInArrow(run, schema), by)
    made = {c: sum((F.col("__t")[i][j] * F.col(columns[j]) for j in range(i)), F.col(c).cast("double")) for i, c in enumerate(columns)}
    return joined.withColumns(made).drop("__t").select(*df.columns)


def regressors(events: DataFrame, sessions: DataFrame, tr: float, model: str = "canonical", delays: Sequence[int] = (0,), min_onset: float = -24.0, oversampling: int = 16, session: str = "session", condition: str = "condition", onset: str = "onset", duration: str | None = None, amplitude: str | None = None, n: str = "n") -> DataFrame:
    """(session, scan, name, value): the regressors of every condition of a session at its scans 0 to n - 1, tr seconds apart.

    A condition is a boxcar on a grid of tr / oversampling seconds that begins min_onset before the first
    scan: an event (no duration) is on for one step. It is convolved with each kernel of the model and
    interpolated at the scans; the derivatives are made orthogonal to what comes before them. A fir model
    takes a step a scan. Events before the grid count at its start, those after it at its end. Of several
    that switch on, or off, in one step, the last by (onset, duration, amplitude) counts. Rows with a null
    session, condition or onset are left out; null amplitudes are 1, null durations 0. A session without
    events has no rows.

    The boxcar is never laid out. A switch adds its size times the running sum of the kernel, which is
    constant past the kernel's end: a switch meets only the scans within the kernel by a generated range,
    and the others by a running sum over scans. Work is the number of events times the scans in a kernel.
    """
    if model == "fir":
        oversampling = 1
    held = kernels(model, tr, oversampling, delays)
    names, length = suffixes(model, delays), max(map(len, held))
    sums = [np.concatenate([np.cumsum(h), np.full(length - len(h), h.sum())]) for h in held]
    span = F.col("n") * F.lit(float(tr)) - F.lit(float(min_onset))
    points = F.floor(span / F.lit(float(tr)) * oversampling + 1 + 1e-9)
    grid = sessions.select(F.col(session).alias("s"), F.col(n).cast("long").alias("n")).where("n > 0").withColumn("last", points - 1).withColumn("dt", span / F.col("last"))
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = events.select(F.col(session).alias("s"), F.col(condition).cast("string").alias("c"), F.col(onset).cast("double").alias("at"), (F.coalesce(F.col(duration).cast("double"), zero) if duration else zero).alias("long"), (F.coalesce(F.col(amplitude).cast("double"), one) if amplitude else one).alias("size"))
    step = lambda t: F.least(F.greatest(F.ceil((t - F.lit(float(min_onset))) / F.col("dt") - 1e-9), F.lit(0)), F.col("last"))
    e = rows.dropna(subset=["s", "c", "at"]).join(grid, "s").withColumn("on", step(F.col("at"))).withColumn("end", step(F.col("at") + F.col("long")))
    e = e.withColumn("off", F.when((F.col("end") == F.col("on")) & (F.col("end") < F.col("last")), F.col("end") + 1).otherwise(F.col("end")))
    about = [F.first(c).alias(c) for c in ("n", "dt")]
    switch = lambda c, sign: e.groupBy("s", "c", F.col(c).alias("j")).agg(*about, (sign * F.max_by("size", F.struct("at", "long", "size"))).alias("d"))
    d = switch("on", 1).unionByName(switch("off", -1)).groupBy("s", "c", "j").agg(*about, F.sum("d").alias("d"))
    scan_of = lambda j: (j * F.col("dt") + F.lit(float(min_onset))) / F.lit(float(tr))
    begin = F.greatest(F.floor(scan_of(F.col("j") - 1)), F.lit(0))
    d = d.withColumn("far", F.greatest(F.ceil(scan_of(F.col("j") + length)) + 1, F.lit(0)).cast("long")).withColumn("begin", begin.cast("long"))
    upto = F.least(F.col("far"), F.col("n")) - 1
    near = d.where(F.col("begin") <= upto).withColumn("scan", F.explode(F.sequence("begin", upto)))
    at = (F.col("scan") * F.lit(float(tr)) - F.lit(float(min_onset))) / F.col("dt")
    near = near.withColumn("i", F.floor(at + 1e-9)).withColumn("f", F.greatest(at - F.col("i"), zero))

    def value(h: np.ndarray, m: Column) -> Column:
        return F.when(m < 0, 0.0).when(m >= length, float(h[-1])).otherwise(F.get(F.lit(h.tolist()), m.cast("int")))

    m = F.col("i") - F.col("j")
    each = [F.sum(F.col("d") * ((1 - F.col("f")) * value(h, m) + F.col("f") * value(h, m + 1))).alias(f"v{k}") for k, h in enumerate(sums)]
    near = near.groupBy("s", "c", "scan").agg(*each)
    far = d.where("far < n").groupBy("s", "c", F.col("far").alias("scan")).agg(F.sum("d").alias("rest"))
    every = d.groupBy("s", "c").agg(F.first("n").alias("n")).select("s", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("scan"))
    rest = F.sum(F.coalesce("rest", zero)).over(Window.partitionBy("s", "c").orderBy("scan"))
    out = every.join(near, ["s", "c", "scan"], "left").join(far, ["s", "c", "scan"], "left").withColumn("rest", rest)
    out = out.select("s", "c", "scan", *[(F.coalesce(f"v{k}", zero) + F.col("rest") * float(h[-1])).alias(f"v{k}") for k, h in enumerate(sums)])
    if model != "fir":
        out = orthogonalized(out, ["s", "c"], [f"v{k}" for k in range(len(sums))])
    pieces = F.array(*[F.struct(F.concat("c", F.lit(name)).alias("name"), F.col(f"v{k}").alias("value")) for k, name in enumerate(names)])
    return out.select(F.col("s").alias(session), "scan", F.explode(pieces).alias("x")).select(session, "scan", "x.*")


def drifts(scan: Column, n: int, tr: float, kind: str = "cosine", order: int = 1, cut: float = 128.0) -> list[Column]:
    """Drift columns of n scans, the constant last: cosines of a period of at least `cut` seconds, powers of time (not yet orthogonal), or the constant alone (blank)."""
    if kind == "cosine":
        return design.cosine_drift(scan, n, max(1, int(np.floor(2 * n / cut * tr))))
    if kind == "polynomial":
        return design.poly_drift(scan * F.lit(float(tr)), (n - 1) * tr, order)
    if kind == "blank":
        return [F.lit(1.0)]
    raise ValueError(f"unknown drift model {kind!r}")


def design_matrix(events: DataFrame, sessions: DataFrame, tr: float, n: int, conditions: Sequence[str], model: str = "canonical", drift: str = "cosine", order: int = 1, cut: float = 128.0, delays: Sequence[int] = (0,), min_onset: float = -24.0, session: str = "session", extra: DataFrame | None = None, **columns: str) -> DataFrame:
    """(session, scan, <condition>..., extra columns, drift_1..., constant): the design of every session with n scans; conditions are its columns, in this order.

    A condition that a session lacks is 0 in it. extra(session, scan, ...) adds columns of its own. Polynomial
    drifts are orthogonal to the constant and to each other. columns name those of events, as in
    regressors(). Collinear columns stay as they are; a fit finds them.
    """
    listed = sessions.select(session).distinct()
    names = [c + s for c in conditions for s in suffixes(model, delays)]
    long = regressors(events.where(F.col(columns.get("condition", "condition")).isin(*conditions)), listed.withColumn("n", F.lit(n)), tr, model, delays, min_onset, session=session, **columns)
    wide = long.groupBy(session, "scan").pivot("name", names).agg(F.first("value"))
    out = listed.withColumn("scan", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(wide, [session, "scan"], "left").fillna(0.0, subset=names)
    if extra is not None:
        out = out.join(extra, [session, "scan"], "left")
    made = drifts(F.col("scan"), n, tr, drift, order, cut)
    labels = [*[f"drift_{k}" for k in range(1, len(made))], "constant"]
    out = out.withColumns(dict(zip(labels, made)))
    if drift == "polynomial":
        out = orthogonalized(out, [session], ["constant", *labels[:-1]])
    return out
