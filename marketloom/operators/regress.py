"""Regressions from grouped moments, rank statistics, and tests of significance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, correlation, norm_cdf, safe_div
from marketloom.functions.gram import pair_moments
from marketloom.functions.ranks import ordered_values, quantile_edges, with_avg_rank
from marketloom.functions.rolling import with_position
from marketloom.session import cut_lineage


def market_returns(benchmark: DataFrame) -> DataFrame:
    """Benchmark return by date. The benchmark is one row per trading date, so the single
    ordered partition is bounded by the calendar."""
    by_date = Window.partitionBy(F.lit(0)).orderBy("date")
    r = F.try_divide(F.col("close"), F.lag("close").over(by_date)) - 1
    return benchmark.select("date", r.alias("bench_r")).filter(F.col("bench_r").isNotNull())


def group_returns(proxy: DataFrame, key: str, out: str) -> DataFrame:
    r = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy(key).orderBy("date"))) - 1
    return proxy.select(key, "date", r.alias(out)).filter(F.col(out).isNotNull())


def align_returns(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Inner alignment on date, incomplete rows dropped."""
    return returns.join(market, "date").dropna(subset=["r", "bench_r"])


def beta_alpha(returns: DataFrame, market: DataFrame, rf: float = 0.0, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    out = align_returns(returns, market).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aligned"),
        safe_div(F.covar_samp("r", "bench_r"), F.var_samp("bench_r")).alias("beta"),
        (F.avg("r") * 252).alias("actual_return"),
        (F.avg("bench_r") * 252).alias("market_return"),
    )
    enough = F.col("aligned") >= 2
    zero = F.lit(0.0)
    out = out.withColumn("beta", F.when(enough, F.coalesce("beta", zero)).otherwise(zero))
    for c in ("actual_return", "market_return"):
        out = out.withColumn(c, F.when(enough, F.col(c)).otherwise(zero))
    return out.withColumn("capm_expected_return", F.when(enough, rf + F.col("beta") * (F.col("market_return") - rf)).otherwise(zero)).withColumn(
        "alpha", F.col("actual_return") - F.col("capm_expected_return")
    )


def beta_text(b: DataFrame) -> DataFrame:
    """Band of the beta and sign of the alpha as words."""
    return b.withColumn(
        "beta_band", F.when(F.col("beta") >= 1.25, "more than the market").when(F.col("beta") <= 0.75, "less than the market").otherwise("in line with the market")
    ).withColumn(
        "alpha_sign", F.when(F.col("alpha") > 0, "positive alpha versus CAPM").when(F.col("alpha") < 0, "negative alpha versus CAPM").otherwise("no CAPM alpha detected")
    )


def market_model(returns: DataFrame, market: DataFrame, rf: float = 0.0, keys: Sequence[str] = ("ticker",), least: int = 20) -> DataFrame:
    """Single-factor least squares. Residual volatility divides by n-1."""
    d = rf / 252.0
    pairs = align_returns(returns, market).withColumn("y", F.col("r") - d).withColumn("x", F.col("bench_r") - d)
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.regr_slope("y", "x").alias("beta"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxx("y", "x").alias("sxx"),
        correlation("y", "x").alias("benchmark_correlation"),
    )
    n = F.col("sample_size")
    sse = F.greatest(F.col("syy") - F.col("beta") * F.col("beta") * F.col("sxx"), F.lit(0.0))
    ready = n >= least
    return out.select(
        *keys,
        "sample_size",
        ready.alias("available"),
        F.when(ready, F.col("beta")).alias("beta"),
        F.when(ready, F.col("intercept") * 252).alias("alpha_annualized"),
        F.when(ready, F.coalesce(1 - safe_div(sse, F.col("syy")), F.lit(0.0))).alias("r_squared"),
        F.when(ready, F.sqrt(sse / (n - 1)) * F.sqrt(F.lit(252.0))).alias("residual_volatility"),
        F.when(ready, F.col("benchmark_correlation")).alias("benchmark_correlation"),
    )


def ols_multi(frame: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], least: int | None = None, scale: float = 1.0) -> DataFrame:
    """Multi-regressor least squares per group: coefficient, standard error and t per term.

    The distributed part is one aggregate of means and covariances (k^2/2 numbers per group,
    combined map-side); the k x k solve runs over batches of those rows.
    """
    names = list(xs)
    k = len(names)
    need = least if least is not None else max(30, k + 5)
    clean = frame.dropna(subset=[y, *names])
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("m_y"), F.var_pop(y).alias("v_y")]
    aggs += [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)]
    aggs += [F.covar_pop(x, y).alias(f"c_{i}") for i, x in enumerate(names)]
    aggs += [F.covar_pop(names[i], names[j]).alias(f"s_{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = clean.groupBy(*keys).agg(*aggs)
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*keys).schema)
    ddl = f"{key_ddl}, sample_size long, r_squared double, residual_std double, term string, coefficient double, std_error double, t_stat double"
    key_list = list(keys)

    def solve(batches):
        for pdf in batches:
            rows = []
            for rec in pdf[pdf["n"] >= need].itertuples(index=False):
                n = rec.n
                s = np.empty((k, k))
                for i in range(k):
                    for j in range(i, k):
                        s[i, j] = s[j, i] = getattr(rec, f"s_{i}_{j}") * n
                c = np.array([getattr(rec, f"c_{i}") for i in range(k)]) * n
                means = np.array([getattr(rec, f"m_{i}") for i in range(k)])
                inv = np.linalg.pinv(s)
                beta = inv @ c
                syy = rec.v_y * n
                sse = max(syy - beta @ c, 0.0)
                mse = sse / max(n - k - 1, 1)
                var = np.concatenate([[mse * (1.0 / n + means @ inv @ means)], mse * np.diag(inv)])
                coef = np.concatenate([[rec.m_y - beta @ means], beta])
                err = np.sqrt(np.maximum(var, 0.0))
                r2 = 1 - sse / syy if syy else 0.0
                head = [getattr(rec, c0) for c0 in key_list]
                for term, b, e in zip(["alpha", *names], coef, err):
                    rows.append([*head, n, r2, float(np.sqrt(sse / (n - 1))), term, float(b), float(e) if e else None, float(b / e) if e else None])
            cols = [*key_list, "sample_size", "r_squared", "residual_std", "term", "coefficient", "std_error", "t_stat"]
            yield pd.DataFrame(rows, columns=cols)

    out = moments.mapInPandas(solve, ddl)
    return out.withColumn("coefficient", F.when(F.col("term") == "alpha", F.col("coefficient") * scale).otherwise(F.col("coefficient")))


def two_factor_frame(returns: DataFrame, market: DataFrame, sectors: DataFrame) -> DataFrame:
    """(ticker, sector, date, r, bench_r, sector_r) on dates where all three exist."""
    return returns.join(market, "date").join(sectors, ["sector", "date"]).dropna(subset=["r", "bench_r", "sector_r"])


def _two_factor_betas(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.covar_pop("r", "bench_r").alias("sym"),
        F.covar_pop("r", "sector_r").alias("sys"),
        F.covar_pop("bench_r", "sector_r").alias("sms"),
        F.var_pop("bench_r").alias("smm"),
        F.var_pop("sector_r").alias("sss"),
        F.var_pop("r").alias("syy"),
    )
    det = F.col("smm") * F.col("sss") - F.col("sms") * F.col("sms")
    out = out.withColumn("market_beta", safe_div(F.col("sym") * F.col("sss") - F.col("sys") * F.col("sms"), det))
    out = out.withColumn("sector_beta", safe_div(F.col("sys") * F.col("smm") - F.col("sym") * F.col("sms"), det))
    r2 = safe_div(F.col("market_beta") * F.col("sym") + F.col("sector_beta") * F.col("sys"), F.col("syy"))
    return out.withColumn("r_squared", clip(r2, 0.0, 1.0))


def beta_stability(frame: DataFrame, block: int = 63) -> DataFrame:
    """Betas on disjoint full blocks; 1 - mean(std/|mean|) over the two betas, clipped to 0..1."""
    ranked = with_position(frame.select("ticker", "date", "r", "bench_r", "sector_r"))
    blocks = ranked.withColumn("block", F.floor(F.col("i") / block)).filter((F.col("block") + 1) * block <= F.col("n_rows"))
    per = _two_factor_betas(blocks, ("ticker", "block"))
    spread = lambda c: F.stddev_pop(c) / F.greatest(F.abs(F.avg(c)), F.lit(1e-6))
    out = per.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("blocks"), ((spread("market_beta") + spread("sector_beta")) / 2).alias("dispersion")
    )
    return out.withColumn("stability", F.when(F.col("blocks") >= 2, clip(1 - F.col("dispersion"), 0.0, 1.0)))


def two_factor(frame: DataFrame, returns: DataFrame, least: int = 80) -> DataFrame:
    """Market and sector sensitivity per ticker with a driver label."""
    recent = with_position(returns).groupBy("ticker").agg(
        F.when(F.max("n_rows") >= 63, F.sum(F.when(F.col("rn") <= 63, F.col("r")))).alias("momentum")
    )
    out = _two_factor_betas(frame, ("ticker",)).join(recent, "ticker").join(beta_stability(frame).select("ticker", "stability"), "ticker", "left")
    ready = F.col("sample_size") >= least
    for c in ("market_beta", "sector_beta", "r_squared", "momentum", "stability"):
        out = out.withColumn(c, F.when(ready, F.col(c)))
    return out.withColumn(
        "driver",
        F.when(~ready, "Not enough data for a reliable factor comparison.")
        .when(F.col("r_squared") >= 0.45, "Performance Driver: Mostly Market and Sector Environment")
        .otherwise("Performance Driver: Meaningful Company-Specific Movement"),
    ).withColumn(
        "confidence", F.when(~ready, "Insufficient Data").when(F.col("stability") >= 0.5, "Medium").otherwise("Low")
    )


def factor_sensitivity(frame: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Share of each factor in the absolute coefficients, with a warning from 35 %."""
    terms = ols_multi(frame, keys, y, xs, least=30).filter(F.col("term") != "alpha")
    total = F.sum(F.abs("coefficient")).over(Window.partitionBy(*keys))
    share = F.round(F.abs("coefficient") / F.when(total == 0, 1.0).otherwise(total) * 100, 2)
    return (
        terms.withColumn("share_pct", share)
        .withColumn("signed_exposure", F.round("coefficient", 4))
        .withColumn("concentrated", F.col("share_pct") >= 35)
    )


#: Columns that a subspace has beyond the wanted components; they speed convergence up, and a universe no larger is solved at once.
SPARE = 27


def correlation_edges(returns: DataFrame, key: str = "ticker", at: str = "date", value: str = "r") -> DataFrame:
    """(`a`, `b`, `corr`) of the whole symmetric correlation matrix without its diagonal of ones; null correlations are zero and left out."""
    pairs = pair_moments(returns, key, at, value).filter(F.col("corr").isNotNull() & (F.col("corr") != 0) & (F.col("a") != F.col("b")))
    swap = F.array(F.struct(F.col("a"), F.col("b"), "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return pairs.select(F.inline(swap))


def _arrays(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _grams(table: DataFrame, *pairs: tuple[str, str]) -> list[np.ndarray]:
    """Sums over all rows of the products of array columns. A task sends one matrix a pair, so what arrives
    grows with the tasks and not with the rows."""

    def run(batches):
        total = None
        for pdf in batches:
            arrays = {c: _arrays(pdf[c]) for c in {x for pair in pairs for x in pair}}
            part = np.concatenate([(arrays[x].T @ arrays[y]).ravel() for x, y in pairs])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"g": [total]})

    rows = table.select(*{x for pair in pairs for x in pair}).mapInPandas(run, "g array<double>").collect()
    total = np.sum([r["g"] for r in rows], axis=0)
    size = int(round((len(total) / len(pairs)) ** 0.5))
    return list(total.reshape(len(pairs), size, size))


def _rotated(table: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """`a` and `v`, the array column times a small matrix."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "v": list(_arrays(pdf[column]) @ matrix)}) if len(pdf) else pd.DataFrame({"a": [], "v": []})

    return table.select("a", column).mapInPandas(run, "a string, v array<double>")


def leading_subspace(edges: DataFrame, names: DataFrame, wanted: int, tolerance: float = 1e-8, rounds: int = 300) -> tuple[DataFrame, np.ndarray]:
    """Eigenvalues (descending) of the matrix `edges` plus the identity, and a table `a`, `v` of its eigenvectors' entries.

    Block subspace iteration. The loadings are a table with one array per series; a round joins the
    matrix's entries with them and sums by series, so no task holds the matrix or a whole row of it. What reaches the driver are
    two matrices of the block's size: they orthogonalise the block, give the Ritz values and the residuals that end the rounds."""
    n = names.count()
    size = min(n, wanted + SPARE)
    if not size:
        return names.select("a", F.array().cast("array<double>").alias("v")), np.zeros(0)
    unit = lambda i: F.pmod(F.xxhash64("a", F.lit(i)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1.0
    block = cut_lineage(names.select("a", F.array(*[unit(i) for i in range(size)]).alias("v")))
    block, size = _orthogonal(block, "v", _grams(block, ("v", "v"))[0])
    for _ in range(rounds):
        entry = lambda i: F.sum(F.col("corr") * F.get("v", F.lit(i))).alias(f"y{i}")
        far = edges.join(block.select(F.col("a").alias("b"), "v"), "b").groupBy("a").agg(*[entry(i) for i in range(size)])
        product = F.array(*[F.get("v", F.lit(i)) + F.coalesce(f"y{i}", F.lit(0.0)) for i in range(size)])
        moved = cut_lineage(block.join(far, "a", "left").select("a", "v", product.alias("y")))
        inner, squares = _grams(moved, ("v", "y"), ("y", "y"))
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        left = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, squares, turn) - ritz**2, 0.0))
        if (left[: min(wanted, size)] <= tolerance * max(ritz[0], 1.0)).all() or size == n:
            return cut_lineage(_rotated(moved, "v", turn[:, :wanted])), ritz
        block, size = _orthogonal(moved, "y", squares)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _orthogonal(table: DataFrame, column: str, gram: np.ndarray) -> tuple[DataFrame, int]:
    """The block with orthonormal columns; directions that have vanished are left out."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(), 1e-300) * 1e-13
    return cut_lineage(_rotated(table, column, vectors[:, good] / np.sqrt(values[good]))), int(good.sum())


def pca(returns: DataFrame, components: int = 5) -> DataFrame:
    """Principal components of standardised returns: explained share, loadings (the largest is positive), and how many
    components explain more than 5 %.

    Runs jobs: the correlations are summed as blocked pair moments and stored; their leading subspace is iterated, see `leading_subspace`."""
    names = cut_lineage(returns.select(F.col("ticker").alias("a")).distinct())
    edges = cut_lineage(correlation_edges(returns))
    vectors, values = leading_subspace(edges, names, components)
    total = names.count()
    share = values / max(total, 1)
    shown = min(components, len(values))
    largest = vectors.agg(*[F.max_by(F.sign(F.get("v", F.lit(i))), F.struct(F.abs(F.get("v", F.lit(i))))).alias(f"s{i}") for i in range(shown)]) if shown else None
    signs = [1.0 if s is None or s >= 0 else -1.0 for s in largest.first()] if shown else []
    parts = [F.struct(F.lit(i + 1).alias("component"), F.lit(float(share[i] * 100)).alias("explained_variance_pct"), F.col("a").alias("ticker"), (F.get("v", F.lit(i)) * signs[i]).alias("loading"), F.lit(int((share > 0.05).sum())).alias("effective_factor_count")) for i in range(shown)]
    empty = "array<struct<component:int,explained_variance_pct:double,ticker:string,loading:double,effective_factor_count:int>>"
    return vectors.select(F.inline(F.array(*parts).cast(empty)))


def ic_buckets(frame: DataFrame, keys: Sequence[str], score: str, future: str, quantiles: int = 5, per_bucket: int = 10) -> DataFrame:
    """Mean forward return per score quantile (right-closed edges, duplicate edges dropped),
    top-minus-bottom spread, rank correlation, and whether the means never fall."""
    clean = frame.dropna(subset=[score, future]).select(*keys, score, future)
    probs = [i / quantiles for i in range(quantiles + 1)]
    edges = quantile_edges(clean, keys, score, probs)
    inner = F.array_distinct(F.transform("edges", lambda e: F.round(e, 12)))
    at = F.greatest(F.size(F.filter("_cut", lambda e: e < F.round(F.col(score), 12))) - 1, F.lit(0))
    placed = clean.join(edges, list(keys)).withColumn("_cut", inner).withColumn("bucket", at)
    means = placed.groupBy(*keys, "bucket").agg(F.avg(future).alias("mean_return"), F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy(*keys).orderBy("bucket")  # at most `quantiles` rows per group
    shape = (
        means.withColumn("_step", F.col("mean_return") - F.lag("mean_return").over(by))
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("observations"),
            F.count(F.lit(1)).alias("buckets"),
            F.max_by("mean_return", "bucket").alias("top"),
            F.min_by("mean_return", "bucket").alias("bottom"),
            F.coalesce(F.min("_step") >= 0, F.lit(True)).alias("positive_monotonicity"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "mean_return"))), lambda s: F.format_string("%.6f", s["mean_return"])), "|").alias("bucket_returns"),
        )
    )
    ranked = with_avg_rank(with_avg_rank(clean, keys, score, "_rs", "_n1"), keys, future, "_rf", "_n2")
    ic = ranked.groupBy(*keys).agg(correlation("_rs", "_rf").alias("information_coefficient"))
    out = shape.join(ic, list(keys)).filter(F.col("observations") >= quantiles * per_bucket)
    return out.withColumn("top_minus_bottom_return", F.when(F.col("buckets") >= 2, F.col("top") - F.col("bottom")).otherwise(F.lit(0.0)))


def benjamini_hochberg(tests: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Adjusted p per row; null p stays null. Equal p values share the rank of the last one.

    Ranking and the running minimum from the largest p are both done per value range, with one
    row per range carried over, so the number of tests is not bounded by a task.
    """
    ranked = ordered_values(tests, keys, p).withColumn("_raw", F.col(p) * F.col("_n") / F.col("_hi"))
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    tails = ranked.groupBy(*keys, "_range").agg(F.min("_raw").alias("_m")).withColumn("_above", F.min("_m").over(above)).drop("_m")
    adjusted = (
        ranked.withColumn("_in", F.min("_raw").over(down))
        .join(tails, [*keys, "_range"])
        .select(*keys, p, F.least(F.col("_in"), F.col("_above"), F.lit(1.0)).alias("adjusted_p"))
    )
    return tests.join(adjusted, [*keys, p], "left")


def bonferroni(tests: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    out = tests.groupBy(*keys).agg(F.min(p).alias("raw_best_p_value"), F.count(F.lit(1)).alias("strategy_count"))
    adj = F.least(F.lit(1.0), F.col("raw_best_p_value") * F.greatest(F.col("strategy_count"), F.lit(1)))
    return out.withColumn("bonferroni_adjusted_p_value", adj).withColumn("warning", adj > 0.05)


def t_columns(n: Column, mean: Column, sd: Column, least: int = 3) -> tuple[Column, Column, Column]:
    """95 % interval and two-sided p against zero (of `least` values on), normal form."""
    margin = 1.96 * sd / F.sqrt(n)
    low = F.when(n >= 2, mean - margin).when(n == 1, mean)
    high = F.when(n >= 2, mean + margin).when(n == 1, mean)
    flat = F.when(mean != 0, F.lit(0.0)).otherwise(F.lit(1.0))
    p = F.when(n >= least, F.when(sd == 0, flat).otherwise(2 * (1 - norm_cdf(F.abs(mean / F.nullif(sd / F.sqrt(n), F.lit(0.0)))))))
    return low, high, p


def one_sample_t(values: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    out = values.groupBy(*keys).agg(F.count(x).alias("sample_size"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    low, high, p = t_columns(F.col("sample_size"), F.col("mean"), F.col("sd"))
    return out.withColumn("ci_low", low).withColumn("ci_high", high).withColumn("p_value", p)
