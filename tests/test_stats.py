"""Published and textbook values of the statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprolith.operators import stats as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("s,n,lo,hi", [(15, 20, 0.531299122381256, 0.8881382985923343), (0, 20, 0, 0.16112515805281938), (20, 20, 0.8388748419471806, 1), (0, 0, 0, 0)])
def test_wilson(spark, s, n, lo, hi):
    a, b = T.wilson(F.lit(s), F.lit(n))
    r = one(spark, a=a, b=b)
    assert r.a == pytest.approx(lo, abs=1e-12) and r.b == pytest.approx(hi, abs=1e-12)


@pytest.mark.parametrize("b,a,p,odds", [(10, 18, 0.013814147851967652, 9.0), (9, 16, 0.04837206505727084, 4.888888888888889)])
def test_fisher(spark, b, a, p, odds):
    c = [F.lit(x) for x in (a, 20 - a, b, 20 - b)]
    r = one(spark, p=T.fisher(*c), odds=T.odds_ratio(*c), less=T.fisher(*c, "less"))
    assert r.p == pytest.approx(p, rel=1e-9) and r.odds == pytest.approx(odds)
    table = [math.comb(20, k) * math.comb(20, a + b - k) / math.comb(40, a + b) for k in range(a + b - 20, a + 1)]
    assert r.less == pytest.approx(sum(table), rel=1e-9)


def test_effects(spark):
    r = one(spark, h=T.cohen_h(F.lit(0.5), F.lit(0.9)), label=T.cohen_label(T.cohen_h(F.lit(0.5), F.lit(0.9))), up=T.relative_change(F.lit(0.5), F.lit(0.9)), none=T.relative_change(F.lit(0.0), F.lit(0.9)), zero=T.relative_change(F.lit(0.0), F.lit(0.0)), inf=T.odds_ratio(F.lit(5), F.lit(0), F.lit(3), F.lit(2)), no=T.odds_ratio(F.lit(5), F.lit(1), F.lit(0), F.lit(2)))
    assert r.h == pytest.approx(0.9272952180016121) and r.label == "large" and r.up == pytest.approx(80)
    assert r.none is None and r.zero == 0 and r.inf == math.inf and r.no is None


def test_holm(spark):
    df = spark.createDataFrame([(float(p),) for p in ".001 .01 .03 .06 .10".split()], "p double")
    got = T.holm(df, "p").orderBy("p").collect()
    assert [r.adjusted_p for r in got] == [pytest.approx(0.005), pytest.approx(0.04), pytest.approx(0.09), None, None]
    assert [r.rejected for r in got] == [True, True, False, False, False]
    assert [r.adjusted_p for r in T.holm(df, "p", monotone=True).orderBy("p").collect()] == [pytest.approx(x) for x in (0.005, 0.04, 0.09, 0.12, 0.12)]


def test_wilcoxon():
    x = np.array([3, 4, 5, 4, 3]) / 10
    r = T.signed_rank(x, np.array([16, 18, 17, 18, 19]) / 20)
    assert r["significant"] and r["p"] < 0.05
    assert T.signed_rank(x, x)["p"] == 1.0
    assert T.signed_rank(x[:2], x[:2])["p"] is None
    assert T.signed_rank(np.zeros(5), np.array([1.0, 2, 3, 4, 5]))["p"] == pytest.approx(1 / 32)
    with pytest.raises(ValueError):
        T.signed_rank(x, x[:3])


def test_wilcoxon_of_every_customer(spark, tmp_path):
    from reprolith.plans.stat_queries import QUERIES

    rng = np.random.default_rng(3)
    orders = [(c, float(x)) for c in range(600) for x in rng.integers(1, 40, rng.integers(1, 4))]
    orders += [(1000, 5.0), (1000, 7.0)]
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.g: r for r in QUERIES["t14_wilcoxon"][0](spark, str(tmp_path)).collect()}
    of = {}
    for c, x in orders:
        of.setdefault(c, []).append(x)
    assert set(got) == set(range(5))
    for g, r in got.items():
        b, a = (np.array([f(v) for c, v in of.items() if c % 5 == g]) for f in (np.mean, max))
        want = T.signed_rank(b, a)
        assert r.w == pytest.approx(want["w"]) and r.p == pytest.approx(want["p"]) and r.significant == want["significant"]
        assert r.median_gain == pytest.approx(np.median(a - b)) and r.mean_gain == pytest.approx((a - b).mean())


def test_wilcoxon_groups_are_signed_ranks(spark):
    rng = np.random.default_rng(4)
    data = {"exact": rng.normal(1, 2, (12, 2)), "ties": rng.integers(0, 4, (60, 2)) * 1.0, "same": np.ones((5, 2)), "few": np.ones((2, 2)), "down": np.array([[3.0, 1], [4, 1], [7, 2], [9, 1]])}
    rows = [(g, float(b), float(a)) for g, x in data.items() for b, a in x] + [("ties", None, 1.0), ("none", None, 2.0)]
    got = {r.g: r for r in T.wilcoxon(spark.createDataFrame(rows, "g string, b double, a double"), ["g"], "b", "a").collect()}
    assert got["none"].p is None and got["none"].median_gain is None and got["few"].p is None
    for g, x in data.items():
        want = T.signed_rank(x[:, 0], x[:, 1])
        assert (got[g].w, got[g].p) == (pytest.approx(want["w"]), pytest.approx(want["p"])) if len(x) > 2 else got[g].w is None
        assert got[g].median_gain == pytest.approx(np.median(x[:, 1] - x[:, 0]))


def test_shapiro_wilk():
    # Shapiro and Wilk's (1965) weights of men: W = 0.79 there
    w, p = T.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.007, abs=0.002)
    assert T.shapiro_wilk([1, 1, 1]) == (1.0, 1.0)


def test_describe(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(4, 9)], "x double")
    r = T.describe(df, [], "x").first()
    assert (r.n, r["mean"], r["median"], r["min"], r["max"]) == (5, pytest.approx(0.6), 0.6, 0.4, 0.8)


def test_rank_tests(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (3, 5, 6, 7, 7)], "s string, x double").withColumn("g", F.lit(1))
    u = T.mann_whitney(df, ["g"], "s", "x", "a", "b").first()
    assert u.u == 1.5  # 3 against 3 is a half, 4 against 3 is one
    k = T.kolmogorov_smirnov(df, ["g"], "s", "x", "a", "b").first()
    assert k.d == pytest.approx(0.8)


def test_normal_quantile():
    assert T.normal_quantile(0.975) == pytest.approx(T.Z95, abs=1e-12)
    assert T.normal_quantile(0.5) == 0


def test_intervals_hold_the_mean(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(rng.normal(10, 2, 40))], "g int, i int, x double")
    mean = df.agg(F.avg("x")).first()[0]
    b, c = T.bootstrap(df, ["g"], "x", "i").first(), T.bca(df, ["g"], "x").first()
    assert b.ci_low < mean < b.ci_high and c.bca_low < mean < c.bca_high
    assert abs(b.ci_low - c.bca_low) < 0.4 and abs(b.ci_high - c.bca_high) < 0.4


def test_bca_query_draws_a_thousand_resamples(spark, tmp_path):
    from reprolith.plans.stat_queries import QUERIES

    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(lang, int(x)) for lang in ("de", "en") for x in rng.integers(1, 900, 60)], "lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    x = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("x", F.col("n_chars").cast("double"))
    ends = lambda df: sorted((r.lang, r.bca_low, r.bca_high) for r in df.collect())
    got = ends(QUERIES["t3_bca"][0](spark, str(tmp_path)))
    assert got == ends(T.bca(x, ["lang"], "x", resamples=1000)) and got != ends(T.bca(x, ["lang"], "x", resamples=200))


def plain_bca(x, resamples, seed=0):
    """The interval from the whole sample and its jackknife."""
    x = np.sort(x)
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(x, len(x)).mean() for _ in range(resamples)])
    z0 = T.normal_quantile(((means < x.mean()).mean() + (means <= x.mean()).mean()) / 2)
    jack = (x.sum() - x) / (len(x) - 1)
    d = jack.mean() - jack
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z = [z0 + T.normal_quantile(p) for p in (0.025, 0.975)]
    return [np.quantile(means, 0.5 * math.erfc(-(z0 + y / (1 - a * y)) / math.sqrt(2))) for y in z]


@pytest.mark.parametrize("limits", [{}, {"block": 7}, {"table": 0}, {"block": 64, "table": 10}])
def test_bca_of_counts_is_that_of_the_sample(limits):
    rng = np.random.default_rng(8)
    for x in (rng.integers(1, 90, 500).astype(float), rng.exponential(3, 41)):
        assert T.bca_interval(*np.unique(x, return_counts=True), 300, **limits) == pytest.approx(plain_bca(x, 300), rel=1e-12)


def test_bca_by_group(spark):
    rng = np.random.default_rng(9)
    data = {"a": rng.integers(1, 90, 200).astype(float), "b": rng.normal(0, 1, 30), "same": np.full(3, 0.1), "one": np.array([4.0])}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("a", None), ("a", float("nan")), ("none", None), (None, 2.0), (None, 2.0)]
    got = {r.g: (r.bca_low, r.bca_high) for r in T.bca(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got.pop("one") == (4.0, 4.0) and got.pop(None) == (2.0, 2.0) and got.pop("same") == pytest.approx((0.1, 0.1))
    assert all(v is None or math.isnan(v) for v in got.pop("none"))
    assert got == {g: pytest.approx(plain_bca(data[g], 1000), rel=1e-12) for g in ("a", "b")}


def test_groups_of_a_task_hold_keys_and_values_alone(spark):
    from reprolith.plans.stat_queries import QUERIES

    plan = lambda name: QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan("t3_bca") and "HashAggregate" in plan("t3_bca")
    assert "s_name" not in plan("t19_shapiro")


@pytest.mark.parametrize("table", [(747, 1419, 271, 615), (0, 0, 5, 9), (3, 0, 0, 4), (20_000, 70_000, 21_000, 69_500), (15, 2, 16, 1), (900, 100, 100, 900)])
def test_fisher_of_tables_of_any_size(spark, table):
    a, b, c, d = table
    n = a + b + c + d
    lf = math.lgamma
    log_p = lambda k: lf(a + b + 1) + lf(c + d + 1) + lf(a + c + 1) + lf(b + d + 1) - lf(n + 1) - lf(k + 1) - lf(a + b - k + 1) - lf(a + c - k + 1) - lf(d - a + k + 1)
    every = {k: log_p(k) for k in range(max(0, a - d), min(a + b, a + c) + 1)}
    cells = [F.lit(x) for x in table]
    r = one(spark, p=T.fisher(*cells), less=T.fisher(*cells, "less"))
    assert r.p == pytest.approx(min(1.0, sum(math.exp(p) for p in every.values() if p <= every[a] + 1e-7)), rel=1e-6, abs=1e-80)
    assert r.less == pytest.approx(min(1.0, sum(math.exp(p) for k, p in every.items() if k <= a)), rel=1e-6)


def test_bootstrap_draws_are_those_of_the_generator(spark):
    values = np.array([3.0, 1.0, 4.0, 1.0, 5.0])

    def mean(b):
        out = 0.0
        for i in range(1, 6):
            x = ((b * 100003 + i) * 1103515245 + 12345) % 2**31
            x = ((x ^ (x >> 13)) * 69069 + 5) % 2**31
            out += values[(x ^ (x >> 11)) % 5]
        return out / 5

    want = [mean(b) for b in range(1, 10_001)]
    assert T.bootstrap_means(values, np.arange(1, 10_001)) == pytest.approx(want)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(values)] + [(1, 9, None)], "g int, i int, x double")
    r = T.bootstrap(df, ["g"], "x", "i").first()
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))


def test_median_interval_is_near_the_bootstrap_of_the_median(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, 301).astype(float)
    r = T.median_interval(spark.createDataFrame([(1, v) for v in x.tolist()], "g int, x double"), ["g"], "x").first()
    draws = np.quantile([np.median(rng.choice(x, len(x))) for _ in range(4000)], [0.025, 0.975])
    assert r.median_low < np.median(x) < r.median_high
    assert abs(r.median_low - draws[0]) < 40 and abs(r.median_high - draws[1]) < 40
