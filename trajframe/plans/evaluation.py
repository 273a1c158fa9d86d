"""Queries over evaluation: rollouts, kinematics, tests, latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.functions.vectors import euler_to_quaternion
from trajframe.operators import evaluate as V
from trajframe.plans.registry import query
from trajframe.plans.views import events, frames, table

_RO = ", ro AS (SELECT episode_index, frame_index, s0 / 100 AS reward, task = 'purchase' AS done, task = 'signup' AS success FROM fr), fd AS (SELECT episode_index, MIN(frame_index) AS d FROM ro WHERE done GROUP BY 1)"
_ME = _RO + """, me AS (SELECT ro.episode_index, SUM(reward) AS sum_reward, MAX(reward) AS max_reward, BOOL_OR(success) AS success FROM ro LEFT JOIN fd USING (episode_index) WHERE d IS NULL OR frame_index <= d + 1 GROUP BY 1)"""


def _metrics(spark, sf_dir):
    rows = frames(spark, sf_dir).select("episode_index", "frame_index", (F.col("s0") / 100).alias("reward"), (F.col("task") == "purchase").alias("done"), (F.col("task") == "signup").alias("success"))
    return V.rollout_metrics(rows)


@query(_ME + "SELECT episode_index, ROUND(sum_reward, 5) AS sum_reward, ROUND(max_reward, 5) AS max_reward, success FROM me")
def d12_rollout_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("episode_index", F.round("sum_reward", 5).alias("sum_reward"), F.round("max_reward", 5).alias("max_reward"), "success")


@query(_ME + """
, g AS (SELECT episode_index % 3 AS grp, episode_index % 5 AS task, * FROM me)
SELECT grp, task, COUNT(*) AS n, ROUND(AVG(sum_reward), 5) AS mean_sum_reward, ROUND(AVG(max_reward), 5) AS mean_max_reward, ROUND(AVG(CASE WHEN success THEN 100.0 ELSE 0.0 END), 4) AS pc_success FROM g GROUP BY ROLLUP (grp, task)
""")
def d13_evaluation_rollup(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("grp", F.col("episode_index") % 3).withColumn("task", F.col("episode_index") % 5)
    out = V.evaluation_rollup(rows, "grp", "task")
    return out.select("grp", "task", "n", F.round("mean_sum_reward", 5).alias("mean_sum_reward"), F.round("mean_max_reward", 5).alias("mean_max_reward"), F.round("pc_success", 4).alias("pc_success"))


@query("""
, x AS (SELECT episode_index, t, sqrt(pow(s0 - lag(s0) OVER w, 2) + pow(s1 - lag(s1) OVER w, 2)) AS d, least(abs(s0 - lag(s0) OVER w) / 100, 2 * pi() - abs(s0 - lag(s0) OVER w) / 100) / nullif(t - lag(t) OVER w, 0) AS turn FROM fr WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, ROUND(MAX(t) - MIN(t), 2) AS duration, ROUND(SUM(d), 3) AS path_length, ROUND(MAX(turn) * 1000, 5) AS peak_turn, ROUND(AVG(turn) * 1000, 5) AS mean_turn FROM x GROUP BY 1 HAVING COUNT(*) >= 4
""")
def d14_kinematics(spark, sf_dir):
    """Positions from two columns, a turn about one axis from the first."""
    q = euler_to_quaternion(F.lit(0.0), F.lit(0.0), F.col("s0") / 100)
    rows = V.kinematics(frames(spark, sf_dir).withColumn("q", q).withColumn("yaw", F.col("s0") / 100), ["s0", "s1"], "t", "q", "yaw")
    turns = (F.round(F.col(c) * 1000, 5).alias(c) for c in ("peak_turn", "mean_turn"))
    return rows.select("episode_index", F.round("duration", 2).alias("duration"), F.round("path_length", 3).alias("path_length"), *turns)


def _sql_gradient(source: str, name: str, cols: tuple[str, ...]) -> str:
    """A common table expression ``name`` with the derivatives of some columns of ``source`` by t, named after them."""

    def slope(c: str) -> str:
        at = lambda col, k: col if k == 0 else f"{'lag' if k < 0 else 'lead'}({col}, {abs(k)}) OVER w"
        end = lambda s: (
            f"(-(2 * a{s} + b{s}) / nullif(a{s} * (a{s} + b{s}), 0)) * {c} + ((a{s} + b{s}) / nullif(a{s} * b{s}, 0)) * {at(c, s)} - (a{s} / nullif(b{s} * (a{s} + b{s}), 0)) * {at(c, 2 * s)}"
            .replace(f"a{s}", f"({at('t', s)} - t)").replace(f"b{s}", f"({at('t', 2 * s)} - {at('t', s)})")
        )
        h1, h2 = f"(t - {at('t', -1)})", f"({at('t', 1)} - t)"
        inner = f"({at(c, 1)} * {h1} * {h1} + {c} * ({h2} * {h2} - {h1} * {h1}) - {at(c, -1)} * {h2} * {h2}) / nullif({h1} * {h2} * ({h1} + {h2}), 0)"
        return f"CASE WHEN {at('t', -1)} IS NULL THEN {end(1)} WHEN {at('t', 1)} IS NULL THEN {end(-1)} ELSE {inner} END AS {c}"

    return f", {name} AS (SELECT episode_index, frame_index, t, {', '.join(map(slope, cols))} FROM {source} WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))"


def _lengths(name: str, source: str) -> str:
    return f", {name} AS (SELECT episode_index, frame_index, t, sqrt(s0 * s0 + s1 * s1) AS x FROM {source})"


_SMOOTH = (
    ", p0 AS (SELECT episode_index, frame_index, t, s0, s1 FROM fr WHERE length >= 4)"
    + "".join(_sql_gradient(a, b, ("s0", "s1")) + _lengths(f"n{b}", b) for a, b in (("p0", "v"), ("v", "a"), ("a", "j")))
    + """
, jj AS (SELECT episode_index, (x * x + pow(lag(x) OVER w, 2)) / 2 * (t - lag(t) OVER w) AS x FROM nj WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
sv AS (SELECT episode_index, AVG(x) AS m, MAX(x) AS peak, MAX(t) - MIN(t) AS duration FROM nv GROUP BY 1), sa AS (SELECT episode_index, AVG(x) AS m, STDDEV_SAMP(x) AS sd FROM na GROUP BY 1),
sj AS (SELECT episode_index, AVG(x) AS m, STDDEV_SAMP(x) AS sd FROM nj GROUP BY 1), si AS (SELECT episode_index, SUM(x) AS x FROM jj GROUP BY 1)
"""
)
_SMOOTHNESS = {"mean_speed": "sv.m", "peak_speed": "sv.peak", "mean_acc": "sa.m", "sd_acc": "sa.sd", "mean_jerk": "sj.m", "sd_jerk": "sj.sd"}


@query(_SMOOTH + "SELECT sv.episode_index, " + ", ".join(f"ROUND(ln({x}), 5) AS ln_{n}" for n, x in _SMOOTHNESS.items()) + """, ROUND(-ln(pow(duration, 3) / pow(peak, 2) * si.x), 5) AS log_jerk
FROM sv JOIN sa USING (episode_index) JOIN sj USING (episode_index) JOIN si USING (episode_index)""")
def d14_smoothness(spark, sf_dir):
    """Logarithms, as the sizes span many powers of ten."""
    rows = V.kinematics(frames(spark, sf_dir), ["s0", "s1"], "t")
    return rows.select("episode_index", *(F.round(F.log(n), 5).alias(f"ln_{n}") for n in _SMOOTHNESS), F.round("log_jerk", 5).alias("log_jerk"))


_POINTS = """
, r AS (SELECT episode_index, length, p.p, p.p * (length - 1) / 9.0::DOUBLE AS x FROM ep, range(0, 10) p(p)),
pt AS (SELECT r.episode_index, CAST(r.p AS INTEGER) AS point, a.s0 + (b.s0 - a.s0) * (x - floor(x)) AS s0
  FROM r JOIN fr a ON a.episode_index = r.episode_index AND a.frame_index = floor(x) JOIN fr b ON b.episode_index = r.episode_index AND b.frame_index = least(floor(x) + 1, r.length - 1)),
rf AS (SELECT point, AVG(s0) AS s0 FROM pt WHERE episode_index % 10 = 0 GROUP BY 1)
"""


@query(_POINTS + "SELECT point, ROUND(s0, 5) AS s0 FROM rf")
def d16_expert_reference(spark, sf_dir):
    points = V.resample(frames(spark, sf_dir), ["s0"], 10)
    return points.where("episode_index % 10 = 0").groupBy("point").agg(F.round(F.avg("s0"), 5).alias("s0"))


@query(_POINTS + "SELECT pt.episode_index, ROUND(AVG(abs(pt.s0 - rf.s0)), 5) AS mean_error, ROUND(MAX(abs(pt.s0 - rf.s0)), 5) AS max_error, ROUND(sqrt(AVG(pow(pt.s0 - rf.s0, 2))), 5) AS rmse, ROUND(AVG(least(abs(pt.s0 - rf.s0) / 100, 2 * pi() - abs(pt.s0 - rf.s0) / 100)), 3) AS mean_turn FROM pt JOIN rf ON rf.point = pt.point GROUP BY 1")
def d15_accuracy(spark, sf_dir):
    points = V.resample(frames(spark, sf_dir), ["s0"], 10)
    reference = points.where("episode_index % 10 = 0").groupBy("point").agg(F.avg("s0").alias("s0"))
    turned = lambda rows: rows.withColumn("q", euler_to_quaternion(F.lit(0.0), F.lit(0.0), F.col("s0") / 100))
    found = V.accuracy(turned(points), turned(reference), ["s0"], "q")
    return found.select("episode_index", *(F.round(c, 5).alias(c) for c in ("mean_error", "max_error", "rmse")), F.round("mean_turn", 3).alias("mean_turn"))


_G = """
, f AS (SELECT episode_index % 2 AS c, episode_index % 3 AS lv, AVG(s0) AS m0, AVG(s1) AS m1 FROM fr GROUP BY episode_index),
l AS (SELECT c, lv, 'm0' AS feature, m0 AS v FROM f UNION ALL SELECT c, lv, 'm1', m1 FROM f)
"""


def _features(spark, sf_dir):
    per = frames(spark, sf_dir).groupBy("episode_index").agg(F.avg("s0").alias("m0"), F.avg("s1").alias("m1"))
    return per.withColumn("c", F.col("episode_index") % 2).withColumn("lv", F.col("episode_index") % 3)


@query(_G + """
, g AS (SELECT feature, c, COUNT(*) AS n, AVG(v) AS m, VAR_SAMP(v) AS s FROM l GROUP BY 1, 2),
w AS (SELECT x.feature, x.n AS n_a, y.n AS n_b, (x.m - y.m) / sqrt(x.s / x.n + y.s / y.n) AS t, pow(x.s / x.n + y.s / y.n, 2) / (pow(x.s / x.n, 2) / (x.n - 1) + pow(y.s / y.n, 2) / (y.n - 1)) AS dof,
  (x.m - y.m) / sqrt(((x.n - 1) * x.s + (y.n - 1) * y.s) / (x.n + y.n - 2)) AS d FROM g x JOIN g y ON x.feature = y.feature AND x.c = 0 AND y.c = 1)
SELECT feature, n_a, n_b, ROUND(t, 5) AS t, ROUND(dof, 4) AS dof, ROUND(d, 5) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM w
""")
def d17_welch(spark, sf_dir):
    out = V.welch(_features(spark, sf_dir), ["m0", "m1"], "c", 0, 1)
    return out.select("feature", "n_a", "n_b", F.round("t", 5).alias("t"), F.round("dof", 4).alias("dof"), F.round("d", 5).alias("d"), "effect")


@query()
def d18_false_discovery(spark, sf_dir):
    tests = V.welch(_features(spark, sf_dir), ["m0", "m1"], "c", 0, 1).withColumn("p", V.t_p_value("t", "dof"))
    return V.false_discovery(tests).select("feature", "p", "p_fdr", "significant")


@query("""
, d AS (SELECT episode_index, 2 * pi() * (us % 86400000000) / 86400000000.0::DOUBLE AS a FROM fr),
r AS (SELECT episode_index, exp(-COUNT(*) * (pow(AVG(cos(a)), 2) + pow(AVG(sin(a)), 2))) AS p FROM d GROUP BY 1),
k AS (SELECT *, p * COUNT(*) OVER () / RANK() OVER (ORDER BY p) AS raw FROM r),
f AS (SELECT episode_index, p, least(1, MIN(raw) OVER (ORDER BY p DESC)) AS p_fdr FROM k)
SELECT episode_index, ROUND(p, 6) AS p, ROUND(p_fdr, 6) AS p_fdr, p_fdr < 0.05 AS significant FROM f
""")
def d18_daily_rhythm(spark, sf_dir):
    """Rayleigh's test of each episode for a preferred time of day, adjusted over all episodes."""
    a = 2 * F.pi() * (F.col("us") % 86_400_000_000) / 86_400_000_000.0
    tests = frames(spark, sf_dir).groupBy("episode_index").agg(F.exp(-F.count(F.lit(1)) * (F.pow(F.avg(F.cos(a)), 2) + F.pow(F.avg(F.sin(a)), 2))).alias("p"))
    return V.false_discovery(tests).select("episode_index", F.round("p", 6).alias("p"), F.round("p_fdr", 6).alias("p_fdr"), "significant")


@query(_ME + """
, c AS (SELECT COUNT(*) FILTER (episode_index % 2 = 0 AND success) AS a, COUNT(*) FILTER (episode_index % 2 = 0 AND NOT success) AS b, COUNT(*) FILTER (episode_index % 2 = 1 AND success) AS c2, COUNT(*) FILTER (episode_index % 2 = 1 AND NOT success) AS d FROM me),
m AS (SELECT *, a + b + c2 + d AS n, a + b AS r, a + c2 AS k FROM c),
f AS (SELECT m.*, x, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) AS lp
  FROM m, range(0, (SELECT least(r, k) FROM m) + 1) t(x) WHERE x >= greatest(0, k - (n - r)))
SELECT a, b, c2, d, ROUND(least(1, SUM(exp(lp)) FILTER (lp <= (SELECT lp FROM f g WHERE g.x = g.a) + 1e-7)), 6) AS p FROM f GROUP BY a, b, c2, d
""")
def d19_fisher(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("c", F.col("episode_index") % 2)
    one = m.agg(*(F.count_if((F.col("c") == c) & (F.col("success") == s)).alias(n) for n, c, s in (("a", 0, True), ("b", 0, False), ("c2", 1, True), ("d", 1, False))))
    return one.withColumn("p", F.round(V.fisher_p_value("a", "b", "c2", "d"), 6))


@query(_G + """
, g AS (SELECT feature, lv, COUNT(*) AS n, AVG(v) AS m, VAR_SAMP(v) AS s FROM l GROUP BY 1, 2),
t AS (SELECT feature, COUNT(*) AS groups, SUM(n) AS nn, SUM(n * m) / SUM(n) AS mu, SUM((n - 1) * s) AS ssw FROM g GROUP BY 1)
SELECT t.feature, groups, ROUND(SUM(n * pow(m - mu, 2)) / (groups - 1) / (ssw / (nn - groups)), 4) AS f, groups - 1 AS d1, CAST(nn - groups AS BIGINT) AS d2 FROM g JOIN t ON t.feature = g.feature GROUP BY t.feature, groups, ssw, nn
""")
def d20_anova(spark, sf_dir):
    out = V.anova(_features(spark, sf_dir), ["m0", "m1"], "lv")
    return out.select("feature", "groups", F.round("f", 4).alias("f"), "d1", "d2")


@query("""
, a AS (SELECT episode_index, AVG(s0) AS e FROM fr GROUP BY 1), b AS (SELECT episode_index, AVG(s1) AS e FROM fr WHERE episode_index % 3 > 0 GROUP BY 1),
g AS (SELECT a.e - b.e AS g FROM a JOIN b USING (episode_index))
SELECT COUNT(*) AS n, ROUND(AVG(g), 5) AS mean_gap, ROUND(AVG(g) / (STDDEV_SAMP(g) / sqrt(COUNT(*))), 5) AS t, COUNT(*) - 1 AS dof FROM g
""")
def d21_paired_t(spark, sf_dir):
    rows = frames(spark, sf_dir)
    a = rows.groupBy("episode_index").agg(F.avg("s0").alias("e"))
    b = rows.where("episode_index % 3 > 0").groupBy("episode_index").agg(F.avg("s1").alias("e"))
    return V.paired_t(a, b, "episode_index", "e").select("n", F.round("mean_gap", 5).alias("mean_gap"), F.round("t", 5).alias("t"), "dof")


@query("""
, w AS (SELECT a.episode_index, a.frame_index, AVG(abs(b.s0 - a.s1)) AS e FROM fr a JOIN fr b ON a.episode_index = b.episode_index AND b.frame_index BETWEEN a.frame_index AND a.frame_index + 3 GROUP BY 1, 2)
SELECT episode_index, ROUND(AVG(e), 4) AS error FROM w GROUP BY 1
""")
def d22_masked_error(spark, sf_dir):
    from trajframe.operators.windows import delta_window

    rows = delta_window(frames(spark, sf_dir), "s0", [0, 1, 2, 3])
    samples = rows.select("episode_index", F.transform("s0_window", lambda x: F.array(x)).alias("y"), F.array_repeat(F.array("s1"), 4).alias("p"), F.col("s0_window_is_pad").alias("pad"))
    return V.masked_error(samples, "y", "p", "pad", "episode_index").withColumn("error", F.round("error", 4))


_L = ", lb AS (SELECT d.source, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


@query(_L + """
, k AS (SELECT CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END AS kind FROM lb UNION ALL SELECT 'failure:' || source FROM lb WHERE quality = 0)
SELECT kind, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM lb), 6) AS rate FROM k GROUP BY 1
""")
def d23_success_table(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return V.success_table(rows, "quality", "source").withColumn("rate", F.round("rate", 6))


@query("SELECT d.lang, COUNT(*) AS n, COUNT(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def c16_labels_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"))


@query("SELECT task, ROUND(SUM(s0 * (s1 + 1)) / SUM(s1 + 1), 5) AS mean FROM fr GROUP BY 1")
def d25_weighted_mean(spark, sf_dir):
    return V.weighted_mean(frames(spark, sf_dir).withColumn("n", F.col("s1") + 1), ["task"], "s0", "n").withColumn("mean", F.round("mean", 5))


@query("SELECT ROUND(AVG(k), 4) AS mean, ROUND(quantile_cont(k, 0.99), 4) AS p99, MIN(k) AS min, MAX(k) AS max, ROUND(10 * 6 / AVG(k), 5) AS compression FROM (SELECT CAST(s1 AS BIGINT) + 1 AS k FROM fr) x")
def d26_token_report(spark, sf_dir):
    one = V.token_report(frames(spark, sf_dir).select((F.col("s1").cast("long") + 1).alias("k")), "k", 10, 6)
    return one.select(F.round("mean", 4).alias("mean"), F.round("p99", 4).alias("p99"), "min", "max", F.round("compression", 5).alias("compression"))


@query("SELECT episode_index, frame_index, ROUND(quantile_cont(s0, 0.95) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS p95, ROUND(MAX(s0) OVER (PARTITION BY episode_index ORDER BY frame_index), 4) AS most FROM fr")
def d27_latency(spark, sf_dir):
    return V.latency(frames(spark, sf_dir), "episode_index", "frame_index", "s0", 20).select("episode_index", "frame_index", F.round("p95", 4).alias("p95"), F.round("most", 4).alias("most"))


@query("SELECT episode_index, ROUND(SUM(s0), 3) AS reward, BOOL_OR(task = 'error') AS intervened, ROUND(AVG(CASE WHEN task = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM fr GROUP BY 1")
def d31_interventions(spark, sf_dir):
    rows = events(spark, sf_dir).select("episode_index", F.col("s0").alias("reward"), (F.col("task") == "error").alias("intervention"))
    return V.interventions(rows, "episode_index").select("episode_index", F.round("reward", 3).alias("reward"), "intervened", F.round("rate", 6).alias("rate"))
