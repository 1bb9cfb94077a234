"""Verbs of statistics: pairs of fields, survival, sparklines, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import Stream, all_present, col, nonempty, number
from .aggregates import grouped
from .registry import verb

#: The eight levels of a sparkline.
TICKS = "▁▂▃▄▅▆▇█"


def ticks(values: Column) -> Column:
    """An array of numbers as one line of levels between its least and greatest."""
    lo, hi = F.array_min(values), F.array_max(values)
    level = lambda v: F.when(hi > lo, F.least(F.lit(7), F.floor((v - lo) * 8 / (hi - lo)))).otherwise(0).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(TICKS), level(v) + 1, F.lit(1))), "")


@verb("sparkline", "-f=f:list")
def sparkline(s: Stream, f=()) -> Stream:
    """One record a field: ``field, n, lo, hi, sparkline`` over all records in order."""
    order = s.first_key() if s.order else F.lit(0)
    down = not s.order or s.order[0][1]
    held = s.df.agg(*[F.array_sort(F.collect_list(F.when(number(s, x).isNotNull(), F.struct(order.alias("o"), number(s, x).cast("double").alias("v"))))).alias(x) for x in f])
    rows = []
    for i, x in enumerate(f):
        values = F.transform(col(x), lambda r: r["v"])
        if not down:
            values = F.reverse(values)
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(x).alias("field"), F.size(values).cast("bigint").alias("n"), F.array_min(values).alias("lo"), F.array_max(values).alias("hi"), ticks(values).alias("sparkline")))
    out = held.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    return Stream.of(out, "i").select(["field", "n", "lo", "hi", "sparkline"])


@verb("surv", "-d=d:str -s=status:str")
def surv(s: Stream, d=None, status=None) -> Stream:
    """Kaplan-Meier: ``time, survival`` at the times of events (status 1), censored otherwise."""
    s = s.where(all_present(s, [d, status]))
    t = s.df.groupBy(number(s, d).alias("time")).agg(F.sum(F.when(number(s, status) == 1, 1).otherwise(0)).alias("events"), F.count("*").alias("n"))
    later = Window.orderBy(F.col("time").desc())
    risk = F.sum("n").over(later.rowsBetween(Window.unboundedPreceding, 0))
    steps = t.withColumn("risk", risk).withColumn("keep", 1 - F.col("events") / F.col("risk"))
    out = steps.withColumn("survival", F.product("keep").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))).where("events > 0")
    return Stream.of(out.select("time", "survival"), "time")


PAIR_STATS = ("linreg-ols", "linreg-pca", "r2", "logireg", "corr", "cov", "covx")


def _pca(x: str, y: str, p: dict[str, Column], verbose: bool) -> dict[str, Column]:
    """Principal axes of a 2 x 2 covariance matrix, in closed form."""
    a, b, c = p["vx"], p["cov"], p["vy"]
    mid, half = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, 2) + b * b)
    l1, l2 = mid + half, mid - half
    # the eigenvector of the greater eigenvalue
    raw1 = F.when(b != 0, l1 - c).when(a >= c, F.lit(1.0)).otherwise(F.lit(0.0))
    raw2 = F.when(b != 0, b).when(a >= c, F.lit(0.0)).otherwise(F.lit(1.0))
    length = F.sqrt(raw1 * raw1 + raw2 * raw2)
    e1, e2 = raw1 / length, raw2 / length
    m = F.try_divide(e2, e1)
    big, small = F.greatest(F.abs(l1), F.abs(l2)), F.least(F.abs(l1), F.abs(l2))
    quality = F.when(big == 0, F.lit(0.0)).otherwise(small / big)
    k = f"{x}_{y}_pca_"
    out = {}
    if verbose:
        out = {
            f"{k}xmean": p["mx"], f"{k}ymean": p["my"], f"{k}xvar": a, f"{k}xycov": b, f"{k}yvar": c, f"{k}l1": l1, f"{k}l2": l2,
            f"{k}v11": e1, f"{k}v12": e2, f"{k}v21": -e2, f"{k}v22": e1,
        }
    return out | {f"{k}m": m, f"{k}b": p["my"] - m * p["mx"], f"{k}n": p["n"], f"{k}quality": quality}


@verb("stats2", "-a=a:list -f=f:list -g=g:list -v=v:true -s=s_:true --fit=fit:true -S=text:true -F=float:true")
def stats2(s: Stream, a=(), f=(), g=(), v=False, fit=False, s_=False, text=False, float=False) -> Stream:
    """Statistics of pairs of fields by group; with ``fit`` each record gets its fitted values.

    All but logistic regression are closed forms over one aggregation.
    """
    pairs = list(zip(f[::2], f[1::2]))
    s = s.where(all_present(s, g))
    basis, names = {}, {}
    for i, (x, y) in enumerate(pairs):
        ok = nonempty(s, x) & nonempty(s, y)
        X, Y = F.when(ok, number(s, x).cast("double")), F.when(ok, number(s, y).cast("double"))
        parts = {
            "n": F.count(X), "mx": F.avg(X), "my": F.avg(Y), "vx": F.var_samp(X), "vy": F.var_samp(Y), "cov": F.covar_samp(X, Y), "corr": F.corr(X, Y),
            "m": F.regr_slope(Y, X), "b": F.regr_intercept(Y, X), "r2": F.regr_r2(Y, X),
        }
        if "logireg" in a:
            parts["xy"] = F.collect_list(F.when(ok, F.struct(X.alias("x"), Y.alias("y"))))
        for k, e in parts.items():
            basis[f"_{i}{k}"] = e
        names[i] = {k: F.col(f"_{i}{k}") for k in parts}
    held = grouped(s, g, basis)
    out = {}
    fits = {}
    for i, (x, y) in enumerate(pairs):
        p, k = names[i], f"{x}_{y}"
        for how in a:
            if how == "linreg-ols":
                out |= {f"{k}_ols_m": p["m"], f"{k}_ols_b": p["b"], f"{k}_ols_n": p["n"]}
                fits[f"{k}_ols_fit"] = (x, p["m"], p["b"], False)
            elif how == "r2":
                out[f"{k}_r2"] = p["r2"]
            elif how == "corr":
                out[f"{k}_corr"] = p["corr"]
            elif how == "cov":
                out[f"{k}_cov"] = p["cov"]
            elif how == "covx":
                out |= {f"{k}_xvar": p["vx"], f"{k}_xycov": p["cov"], f"{k}_yxcov": p["cov"], f"{k}_yvar": p["vy"]}
            elif how == "linreg-pca":
                got = _pca(x, y, p, v)
                out |= got
                fits[f"{k}_pca_fit"] = (x, got[f"{k}_pca_m"], got[f"{k}_pca_b"], False)
            elif how == "logireg":
                mb = _logistic(p["xy"])
                out |= {f"{k}_logistic_m": mb["m"], f"{k}_logistic_b": mb["b"], f"{k}_logistic_n": p["n"]}
                fits[f"{k}_logistic_fit"] = (x, mb["m"], mb["b"], True)
            else:
                raise ValueError(f"stats2: no {how}")
    if not fit:
        return held.select([*g, *[c.alias(n) for n, c in out.items()]])
    fitted = held.df.select(*[col(k).alias(f"_k{j}") for j, k in enumerate(g)], *[c.alias(f"_fit{j}") for j, pair in enumerate(fits.values()) for c in [F.struct(pair[1].alias("m"), pair[2].alias("b"))]])
    if g:
        df = s.df.join(fitted, [col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(g)], "left")
    else:
        from .aggregates import _one_row

        df = _one_row(s.df, fitted)
    new = {}
    for j, (n, (x, _, _, curve)) in enumerate(fits.items()):
        line = F.col(f"_fit{j}.m") * number(s, x) + F.col(f"_fit{j}.b")
        new[n] = 1 / (1 + F.exp(-line)) if curve else line
    return s.with_df(df).with_columns(new).select([*s.columns, *new])


def _logistic(pairs: Column) -> Column:
    """Logistic regression of one variable by Newton's method over a group's pairs."""
    @F.pandas_udf("m double, b double")
    def run(groups: pd.Series) -> pd.DataFrame:
        rows = []
        for g in groups:
            x = np.array([p["x"] for p in g], float)
            y = np.array([p["y"] for p in g], float)
            w = np.zeros(2)
            if len(x) < 2:
                rows.append((None, None))
                continue
            X = np.stack([x, np.ones(len(x))], axis=1)
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(X @ w, -40, 40)))
                h = (X * (p * (1 - p))[:, None]).T @ X + 1e-12 * np.eye(2)
                step = np.linalg.solve(h, X.T @ (y - p))
                w = w + step
                if np.abs(step).max() < 1e-9:
                    break
            rows.append((float(w[0]), float(w[1])))
        return pd.DataFrame(rows, columns=["m", "b"])

    return run(pairs)


def _statistic(name: str, x: np.ndarray, interpolated: bool) -> np.ndarray:
    """A statistic of the rows of a matrix."""
    n = x.shape[1]
    if name == "count":
        return np.full(len(x), n, float)
    if name == "sum":
        return x.sum(axis=1)
    if name == "mean":
        return x.mean(axis=1)
    if name in ("var", "stddev", "meaneb"):
        v = x.var(axis=1, ddof=1) if n > 1 else np.full(len(x), np.nan)
        return v if name == "var" else np.sqrt(v if name == "stddev" else v / n)
    if name in ("min", "max"):
        return getattr(x, name)(axis=1)
    if name == "skewness":
        d = x - x.mean(axis=1, keepdims=True)
        return (d**3).mean(axis=1) / x.var(axis=1, ddof=1) ** 1.5
    if name == "kurtosis":
        d = x - x.mean(axis=1, keepdims=True)
        return (d**4).mean(axis=1) / (d**2).mean(axis=1) ** 2 - 3
    p = 50.0 if name == "median" else float(name[1:])
    if interpolated:
        return np.percentile(x, p, axis=1)
    return np.sort(x, axis=1)[:, min(n - 1, int(p / 100 * n))]


def resampled(held: Stream, a, f, g, n: int, level: float, interpolated: bool, seed: int) -> Stream:
    kinds = T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))])
    @F.pandas_udf(kinds)
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            x = np.asarray(v, float)
            row = []
            if not len(x):
                out.append([None] * (3 * len(a)))
                continue
            rng = np.random.default_rng([seed, len(x)])
            draws: dict[str, list] = {name: [] for name in a}
            done, at_once = 0, max(1, 2_000_000 // len(x))
            while done < n:
                m = min(at_once, n - done)
                some = x[rng.integers(0, len(x), (m, len(x)))]
                for name in a:
                    draws[name].append(_statistic(name, some, interpolated))
                done += m
            for name in a:
                d = np.sort(np.concatenate(draws[name])) if n else np.array([np.nan])
                alpha = (1 - level) / 2
                row += [float(_statistic(name, x[None, :], interpolated)[0]), float(d[min(len(d) - 1, int(alpha * len(d)))]), float(d[min(len(d) - 1, int((1 - alpha) * len(d)))])]
            out.append(row)
        return pd.DataFrame({"s": out})

    cols = []
    df = held.df
    for i, x in enumerate(f):
        df = df.withColumn(f"_{i}", run(col(x)))
        for j, name in enumerate(a):
            for k, end in enumerate(("", "_lo", "_hi")):
                cols.append(F.element_at(F.col(f"_{i}.s"), 3 * j + k + 1).alias(f"{x}_{name}{end}"))
    return held.with_df(df).select([*g, *cols])
