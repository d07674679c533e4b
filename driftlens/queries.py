"""One query for each operator of the library over the given tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import arrays as A
from .operators import cluster as C
from .operators import metrics as M
from .operators import neighbors as J
from .operators import normalize as N
from .operators import prefix as P
from .operators import records as R
from .operators import sweep
from .operators import window as W
from .plans import detect
from .sources import scratch
from .sources import series as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---- SQL of the fixtures ----
U = """u AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x,
  CAST(event_type = 'error' AS INT) AS label FROM events),
meta AS (SELECT series_id, count(*) AS n, CAST(floor(count(*) / 2) AS BIGINT) AS train_index FROM u GROUP BY 1)"""
LONG = """l0 AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS x FROM events),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY x DESC, t) <= ceil(count(*) OVER (PARTITION BY series_id) / 100) AS INT) AS label FROM l0)"""
MANY = """mh AS (SELECT user_id % 10 AS series_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS t, event_type, value FROM events),
m AS (SELECT g.series_id, g.t, [coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0.0), coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0.0),
  coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0.0), coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0.0), coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0.0)] AS x
  FROM (SELECT DISTINCT series_id, unnest(range(0, 720)) AS t FROM (SELECT DISTINCT series_id FROM mh)) g LEFT JOIN mh ON g.series_id = mh.series_id AND g.t = mh.t GROUP BY 1, 2)"""
V = """v AS (SELECT vec_id, CAST(label AS BIGINT) AS series_id, CAST(embedding AS DOUBLE[]) AS v,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) <= count(*) OVER (PARTITION BY label) / 2.0 AS is_train FROM embeddings)"""
UNITS = """units AS (SELECT o_orderpriority AS method, CASE WHEN n_regionkey < 3 THEN 'U' ELSE 'M' END AS track, n_name AS dataset, CAST(o_orderkey AS VARCHAR) AS file,
  2026 AS seed, (c * 1) % 1000 / 1000.0 AS vus_pr, (c * 2) % 1000 / 1000.0 AS vus_roc, (c * 3) % 1000 / 1000.0 AS range_f1, (c * 4) % 1000 / 1000.0 AS auc_pr,
  (c * 5) % 1000 / 1000.0 AS auc_roc, (c * 6) % 1000 / 1000.0 AS best_f1, CASE WHEN o_orderkey % 97 = 0 THEN 'failed' END AS error
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
WIN = "w AS (SELECT * FROM (SELECT series_id, t AS q, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS v FROM u) WHERE len(v) = 4)"
SPLIT = "tr AS (SELECT w.series_id, q AS m, v AS u FROM w JOIN meta USING (series_id) WHERE q + 4 <= train_index)"
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
MEANS = ", ".join(f"avg({m}) AS {m}" for m in R.METRICS)


def sums(df: DataFrame, keys: list[str], col: str = "w") -> DataFrame:
    """An array as numbers that can be compared: size, sum, sum of squares, place-weighted sum."""
    a = F.col(col)
    weighted = F.aggregate(F.zip_with(a, F.sequence(F.lit(1), F.size(a)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return df.select(*keys, F.size(a).cast("bigint").alias("n"), rnd(A.total(a)).alias("s1"), rnd(A.dot(a, a)).alias("s2"), rnd(weighted).alias("s3"))


def sums_sql(keys: str, source: str, col: str = "w") -> str:
    return f"""SELECT {keys}, CAST(len({col}) AS BIGINT) AS n, round(list_sum({col}), 5) + 0.0 AS s1, round(list_sum(list_transform({col}, lambda x: x * x)), 5) + 0.0 AS s2,
round(list_sum(list_transform(list_zip({col}, range(1, len({col}) + 1)), lambda z: z[1] * z[2])), 5) + 0.0 AS s3 FROM {source}"""


def rnd(c, places: int = 5):
    return F.round(c, places) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def u_windows(s, d, length: int = 4) -> DataFrame:
    return W.windows(S.u_small(s, d), length)


def u_train_query(s, d) -> tuple[DataFrame, DataFrame]:
    """Raw windows of four points: training ones (m, u) from the prefix, queries (q, v) all."""
    u = S.u_small(s, d)
    w = W.windows(u, 4).select("series_id", F.col("start").alias("q"), F.col("w").alias("v"))
    train = w.join(S.meta_of(u), "series_id").where(F.col("q") + 4 <= F.col("train_index"))
    return train.select("series_id", F.col("q").alias("m"), F.col("v").alias("u")), w


def vec_train_query(s, d, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    v = S.vectors(s, d, stored)
    return v.where("is_train").select("series_id", F.col("vec_id").alias("m"), F.col("v").alias("u")), v.select("series_id", F.col("vec_id").alias("q"), "v")


def vec_rows(s, d) -> DataFrame:
    return S.vectors(s, d).select("series_id", F.col("vec_id").alias("q"), "v")


# ---- sources ----
@query("s03_series_from_table", f"WITH {U} SELECT series_id, t, x, label FROM u")
def _s03(s, d):
    return S.u_small(s, d)


NAMES = "names AS (SELECT event_id AS id, lpad(CAST(event_id AS VARCHAR), 3, '0') || '_' || upper(event_type) || '_id_' || user_id || '_Sensor_tr_' || (event_id % 700) || '_1st_' || (event_id % 900) || CASE WHEN event_id % 7 = 0 THEN '' ELSE '.csv' END AS file, event_id % 11 = 0 AS odd FROM events)"


def names(s, d) -> DataFrame:
    e, i = S.table(s, d, "events"), F.col("event_id")
    file = F.concat(F.when(i < 1000, F.lpad(i.cast("string"), 3, "0")).otherwise(F.substring(i.cast("string"), 1, 3)), F.lit("_"), F.upper("event_type"), F.lit("_id_"), "user_id", F.lit("_Sensor_tr_"), i % 700, F.lit("_1st_"), i % 900, F.when(i % 7 == 0, "").otherwise(".csv"))
    return e.select(i.alias("id"), file.alias("file"), (i % 11 == 0).alias("odd"))


@query(
    "s04_parse_series_name",
    f"""WITH {NAMES}, f AS (SELECT id, CASE WHEN odd THEN replace(file, '_tr_', '_xx_') ELSE file END AS file FROM names)
SELECT id, split_part(file, '_', 2) AS dataset, TRY_CAST(regexp_extract(file, '_tr_(\\d+)(?:_|\\.|$)', 1) AS BIGINT) AS train_index,
TRY_CAST(regexp_extract(file, '_1st_(\\d+)(?:_|\\.|$)', 1) AS BIGINT) AS first_anomaly FROM f""",
)
def _s04(s, d):
    f = names(s, d).withColumn("file", F.when(F.col("odd"), F.regexp_replace("file", "_tr_", "_xx_")).otherwise(F.col("file")))
    return f.select("id", *[c.alias(n) for n, c in S.parse_series_name(F.col("file")).items()])


@query(
    "s05_scan_manifest",
    f"""WITH {NAMES}, f AS (SELECT CASE WHEN id % 2 = 0 THEN 'U' ELSE 'M' END AS track, CASE WHEN id % 5 = 0 THEN 'Tuning' ELSE 'Eva' END AS split, replace(file, '.csv', '') AS file_name FROM names)
SELECT track, split, file_name, split_part(file_name, '_', 2) AS dataset, count(*) OVER (PARTITION BY track, split, file_name) > 1 AS duplicate
FROM f WHERE split_part(file_name, '_', 2) IN ('CLICK', 'ERROR')""",
)
def _s05(s, d):
    i = F.col("id")
    f = names(s, d).select(F.when(i % 2 == 0, "U").otherwise("M").alias("track"), F.when(i % 5 == 0, "Tuning").otherwise("Eva").alias("split"), F.regexp_replace("file", r"\.csv", "").alias("file_name"))
    return S.scan_manifest(f, ["CLICK", "ERROR"])


@query("s09_new_units", f"WITH {UNITS} SELECT method, track, dataset, file, error FROM units WHERE NOT (CAST(file AS BIGINT) % 3 = 0)")
def _s09(s, d):
    u = S.units(s, d)
    return R.new_units(u, u.where(F.col("file").cast("bigint") % 3 == 0)).select("method", "track", "dataset", "file", "error")


# ---- filters and samples ----
@query("f01_prefix", f"WITH {U} SELECT series_id, t, x FROM u JOIN meta USING (series_id) WHERE t < train_index")
def _f01(s, d):
    u = S.u_small(s, d)
    return P.prefix(u.select("series_id", "t", "x"), S.meta_of(u))


@query("f02_check_prefix", f"WITH {U} SELECT series_id, n, train_index FROM (SELECT series_id, n, CASE WHEN series_id % 4 = 0 THEN n ELSE train_index - 30 END AS train_index FROM meta) WHERE train_index < 1 OR train_index >= n")
def _f02(s, d):
    m = S.meta_of(S.u_small(s, d))
    return P.check_prefix(m.withColumn("train_index", F.when(F.col("series_id") % 4 == 0, F.col("n")).otherwise(F.col("train_index") - 30)), 1)


@query("f03_select_subsets", f"WITH {UNITS} SELECT method, dataset, file FROM units WHERE dataset IN ('NATION_3', 'NATION_7', 'NATION_11')")
def _f03(s, d):
    return P.select_subsets(S.units(s, d), ["NATION_3", "NATION_7", "NATION_11"]).select("method", "dataset", "file")


@query("f04_drop_incomplete", f"WITH {UNITS} SELECT file, nullif(error, 'x') AS error FROM units WHERE error IS NOT NULL")
def _f04(s, d):
    return P.drop_incomplete(S.units(s, d).select("file", "error"))


BROKEN = "CASE WHEN event_id % 50 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 50 = 1 THEN CAST('inf' AS DOUBLE) WHEN event_id % 50 = 2 THEN CAST('-inf' AS DOUBLE) ELSE value END"


def broken(s, d) -> DataFrame:
    i = F.col("event_id") % 50
    x = F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 2, float("-inf")).otherwise(F.col("value"))
    return S.table(s, d, "events").select("event_id", x.alias("x"))


@query("f05_non_finite", f"SELECT event_id FROM (SELECT event_id, {BROKEN} AS x FROM events) WHERE isnan(x) OR isinf(x)")
def _f05(s, d):
    return P.non_finite(broken(s, d)).select("event_id")


@query("f06_sanitize", f"SELECT event_id, CASE WHEN isnan(x) THEN 0 WHEN x > 1e308 THEN 1e6 WHEN x < -1e308 THEN 0 ELSE x END AS x FROM (SELECT event_id, {BROKEN} AS x FROM events)")
def _f06(s, d):
    return broken(s, d).select("event_id", A.sanitize(F.col("x"), 1e6).alias("x"))


EVEN = """WITH {U}, i AS (SELECT series_id, n, unnest(range(0, 17)) AS i FROM meta)
SELECT DISTINCT u.series_id, t, x FROM u JOIN i ON u.series_id = i.series_id AND t = CAST({f} AS BIGINT) WHERE n > 17"""


@query("f07_even_sample_floor", EVEN.format(U=U, f="floor(i * (n - 1) / 16)"))
def _f07(s, d):
    return P.even_sample(S.u_small(s, d).select("series_id", "t", "x"), 17, ["t"], ["series_id"])


@query("f08_even_sample_rint", EVEN.format(U=U, f="round_even(i * (n - 1) / 16, 0)"))
def _f08(s, d):
    return P.even_sample(S.u_small(s, d).select("series_id", "t", "x"), 17, ["t"], ["series_id"], "rint")


UNI = "CAST('0x' || substr(md5({t}), 1, 12) AS BIGINT) / 281474976710656.0"


@query(
    "f09_sample_rows",
    f"""WITH {U}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h, t) AS r FROM (SELECT series_id, t, n, {UNI.format(t="'f9:' || t")} AS h FROM u JOIN meta USING (series_id))),
d AS (SELECT series_id, CAST(floor({UNI.format(t="'f9:' || series_id || ':' || i")} * n) + 1 AS BIGINT) AS r, count(*) AS draws FROM (SELECT series_id, n, unnest(range(1, 71)) AS i FROM meta WHERE n < 70) GROUP BY 1, 2)
SELECT series_id, t, CAST(1 AS BIGINT) AS draws FROM r WHERE n >= 70 AND r <= 70 UNION ALL SELECT series_id, t, draws FROM r JOIN d USING (series_id, r) WHERE n < 70""",
)
def _f09(s, d):
    return P.sample_rows(S.u_small(s, d).select("series_id", "t"), 70, "f9", F.col("t"), ["series_id"]).select("series_id", "t", "draws")


@query(
    "f10_tempered_sample",
    f"""WITH {U}, mem AS (SELECT series_id, CAST(floor(sqrt(t)) AS BIGINT) AS ball, t AS row_ FROM u),
b AS (SELECT series_id, ball, count(*) AS n FROM mem GROUP BY 1, 2),
c AS (SELECT *, sum(pow(n, 0.5)) OVER (PARTITION BY series_id ORDER BY ball) / sum(pow(n, 0.5)) OVER (PARTITION BY series_id) AS hi FROM b),
e AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY series_id ORDER BY ball), 0) AS lo FROM c),
dr AS (SELECT series_id, draw, {UNI.format(t="'tball:' || series_id || ':' || draw")} AS a, {UNI.format(t="'trow:' || series_id || ':' || draw")} AS z FROM (SELECT series_id, unnest(range(1, 21)) AS draw FROM meta)),
h AS (SELECT dr.series_id, draw, ball, CAST(floor(z * n) + 1 AS BIGINT) AS p FROM dr JOIN e ON dr.series_id = e.series_id AND a >= lo AND a < hi)
SELECT h.series_id, draw, h.ball, row_ AS row FROM h JOIN (SELECT *, row_number() OVER (PARTITION BY series_id, ball ORDER BY row_) AS p FROM mem) k ON h.series_id = k.series_id AND h.ball = k.ball AND h.p = k.p""",
)
def _f10(s, d):
    mem = S.u_small(s, d).select("series_id", F.floor(F.sqrt("t")).alias("ball"), F.col("t").alias("row"))
    return P.tempered_sample(mem, 0.5, 20, "t", ["series_id"]).withColumn("draw", F.col("draw").cast("bigint"))


@query("f11_ordered_split", f"WITH {U} SELECT series_id, t, t + 1 <= greatest(1, least(n - 1, round_even(n * 0.8, 0))) AS is_train FROM u JOIN meta USING (series_id)")
def _f11(s, d):
    return P.ordered_split(S.u_small(s, d).select("series_id", "t"), ["t"], ["series_id"])


@query(
    "f12_smallest_per_group",
    f"WITH {UNITS} SELECT track, file, size FROM (SELECT track, file, CAST(file AS BIGINT) % 777 AS size, row_number() OVER (PARTITION BY track ORDER BY CAST(file AS BIGINT) % 777, file) AS r FROM units WHERE CAST(file AS BIGINT) >= 500) WHERE r = 1",
)
def _f12(s, d):
    u = S.units(s, d).withColumn("size", F.col("file").cast("bigint") % 777)
    return P.smallest_per_group(u, "track", "size", "file", F.col("file").cast("bigint") >= 500)


@query("f13_slice_list", f"WITH {UNITS} SELECT file FROM units ORDER BY file LIMIT 25 OFFSET 40")
def _f13(s, d):
    return P.slice_list(S.units(s, d).select("file"), ["file"], 40, 25)


# ---- normalisation and arrays ----
@query("n01_fit_scaler", f"WITH {MANY} SELECT series_id, CAST(ch - 1 AS INT) AS ch, round(avg(x[ch]), 5) AS mean, round(stddev_pop(x[ch]), 5) AS std FROM m, (SELECT unnest(range(1, 6)) AS ch) WHERE t < 360 GROUP BY 1, 2")
def _n01(s, d):
    m = S.m_points(s, d)
    return N.fit_scaler(P.prefix(m, S.meta_of(m))).select("series_id", "ch", rnd(F.col("mean")).alias("mean"), rnd(F.col("std")).alias("std"))


@query(
    "n02_apply_scaler",
    f"""WITH {U}, sc AS (SELECT series_id, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS std FROM u JOIN meta USING (series_id) WHERE t < train_index GROUP BY 1)
SELECT series_id, t, round((x - mean) / std, 5) + 0.0 AS x FROM u JOIN sc USING (series_id)""",
)
def _n02(s, d):
    u = S.u_small(s, d).select("series_id", "t", "x")
    return N.apply_scaler(u, N.fit_scaler(P.prefix(u, S.meta_of(u)))).select("series_id", "t", rnd(F.col("x")).alias("x"))


ZL = "list_transform(v, lambda x: (x - list_avg(v)) / CASE WHEN list_stddev_pop(v) < 1e-8 THEN 1 ELSE list_stddev_pop(v) END)"


@query("n03_instance_zscore", f"WITH {U}, {WIN} " + sums_sql("series_id, q AS start", f"(SELECT series_id, q, {ZL} AS w FROM w)"))
def _n03(s, d):
    return sums(u_windows(s, d).withColumn("w", A.instance_zscore(F.col("w"))), ["series_id", "start"])


@query(
    "n04_position_scaler",
    f"""WITH {U}, {WIN}, {SPLIT}, sc AS (SELECT series_id, i, avg(u[i]) AS mean, CASE WHEN stddev_pop(u[i]) < 1e-8 THEN 1 ELSE stddev_pop(u[i]) END AS std FROM tr, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1, 2),
z AS (SELECT w.series_id, w.q, list((v[i] - mean) / std ORDER BY i) AS w FROM w JOIN sc USING (series_id) GROUP BY 1, 2) """
    + sums_sql("series_id, q AS start", "z"),
)
def _n04(s, d):
    train, w = u_train_query(s, d)
    z = N.position_scaler(train.select("series_id", F.col("u").alias("w")), w.select("series_id", F.col("q").alias("start"), F.col("v").alias("w")))
    return sums(z, ["series_id", "start"])


@query("n05_revin", f"WITH {U}, {WIN} " + sums_sql("series_id, q AS start", "(SELECT series_id, q, list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5)) AS w FROM w)"))
def _n05(s, d):
    return sums(u_windows(s, d).withColumn("w", A.revin(F.col("w"))), ["series_id", "start"])


@query("n06_l2_normalize", f"WITH {U}, {WIN} " + sums_sql("series_id, q AS start", "(SELECT series_id, q, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS w FROM w)"))
def _n06(s, d):
    return sums(u_windows(s, d).withColumn("w", A.l2_normalize(F.col("w"))), ["series_id", "start"])


@query(
    "n07_pool_tokens",
    f"""WITH {MANY}, g AS (SELECT series_id, t // 24 AS day, list_transform(x, lambda y: y / greatest(sqrt(list_sum(list_transform(x, lambda z: z * z))), 1e-12)) AS k FROM m),
p AS (SELECT series_id, day, i, avg(k[i]) AS a, greatest(stddev_pop(k[i]), 1e-8) AS b FROM g, (SELECT unnest(range(1, 6)) AS i) GROUP BY 1, 2, 3),
z AS (SELECT series_id, day, list(a ORDER BY i) || list(b ORDER BY i) AS w FROM p GROUP BY 1, 2) """
    + sums_sql("series_id, CAST(day AS BIGINT) AS day", "z"),
)
def _n07(s, d):
    g = S.m_points(s, d).groupBy("series_id", F.floor(F.col("t") / 24).alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda r: r["x"]).alias("tokens"))
    return sums(g.withColumn("w", A.pool_tokens(F.col("tokens"), 5)), ["series_id", "day"])


SOFT = "list_transform(v, lambda x: (x + 1) / list_sum(list_transform(v, lambda y: y + 1)))"


def shares(s, d) -> DataFrame:
    """Windows as distributions p, and r made of the same values in reverse."""
    w = u_windows(s, d).select("series_id", F.col("start").alias("q"), A.normalized(F.transform("w", lambda x: x + 1)).alias("p"))
    return w.withColumn("r", F.reverse("p"))


SHARES = f"sh AS (SELECT series_id, q, {SOFT} AS p, list_reverse({SOFT}) AS r FROM w)"
KLD = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * (ln(z[1] + 1e-4) - ln(z[2] + 1e-4))))"


@query("n08_entropy", f"WITH {U}, {WIN}, {SHARES} SELECT series_id, q, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 6) + 0.0 AS h FROM sh")
def _n08(s, d):
    return shares(s, d).select("series_id", "q", rnd(A.entropy(F.col("p")), 6).alias("h"))


@query("n09_kl", f"WITH {U}, {WIN}, {SHARES} SELECT series_id, q, round({KLD.format(a='p', b='r')}, 6) + 0.0 AS kl FROM sh")
def _n09(s, d):
    return shares(s, d).select("series_id", "q", rnd(A.kl(F.col("p"), F.col("r")), 6).alias("kl"))


@query("n10_discrepancy", f"WITH {U}, {WIN}, {SHARES} SELECT series_id, q, round(({KLD.format(a='p', b='r')} + {KLD.format(a='r', b='p')}) / 2, 6) + 0.0 AS d FROM sh")
def _n10(s, d):
    return shares(s, d).select("series_id", "q", rnd(A.discrepancy(F.col("p"), F.col("r")), 6).alias("d"))


@query("n11_softmax", f"WITH {U}, e AS (SELECT *, exp((x - max(x) OVER (PARTITION BY series_id)) * 0.1) AS e FROM u) SELECT series_id, t, round(e / sum(e) OVER (PARTITION BY series_id), 6) AS softmax FROM e")
def _n11(s, d):
    return N.softmax(S.u_small(s, d), "x", ["series_id"], 0.1).select("series_id", "t", rnd(F.col("softmax"), 6).alias("softmax"))


NOISE = f"""f AS (SELECT series_id, q, r AS ratio, CAST(i AS INT) AS pos, v[i + 1] AS value, 'n:' AS s, series_id || ':' || q || ':' || r || ':' || i AS k FROM w, (SELECT unnest([0.25, 0.75]) AS r), (SELECT unnest(range(0, 4)) AS i)),
h AS (SELECT *, {UNI.format(t="'norder:' || k")} AS o, {UNI.format(t="'nsigma:' || k")} AS us, {UNI.format(t="'na:' || k")} AS ua, {UNI.format(t="'nb:' || k")} AS ub, {UNI.format(t="'nkeep:' || k")} AS uk FROM f),
g AS (SELECT *, floor((row_number() OVER (PARTITION BY series_id, q, ratio ORDER BY o, pos) - 1) * 2 / 4) AS band FROM h),
nz AS (SELECT series_id, q, CAST(ratio AS DOUBLE) AS ratio, pos, value, CASE WHEN uk < ratio THEN (band + us) * 2.0 / 2 * sqrt(-2 * ln(1 - ua)) * cos(2 * 3.141592653589793 * ub) ELSE 0 END AS noise FROM g)"""


def noisy(s, d) -> DataFrame:
    w = u_windows(s, d).select("series_id", F.col("start").alias("q"), "w")
    return N.noise_augment(w, 2.0, 2, [0.25, 0.75], "n", ["series_id", "q"])


@query("n12_noise_augment", f"WITH {U}, {WIN}, {NOISE} SELECT series_id, q, ratio, pos, value, round(noise, 6) + 0.0 AS noise FROM nz")
def _n12(s, d):
    return noisy(s, d).withColumn("noise", rnd(F.col("noise"), 6))


@query(
    "n13_noise_targets",
    f"WITH {U}, {WIN}, {NOISE} SELECT DISTINCT series_id, q, 0.0::DOUBLE AS ratio, pos, round(value, 6) + 0.0 AS value, 0.0::DOUBLE AS target FROM nz UNION ALL SELECT series_id, q, ratio, pos, round(value + noise, 6) + 0.0, round(abs(noise), 6) + 0.0 FROM nz",
)
def _n13(s, d):
    return N.noise_targets(noisy(s, d), ["series_id", "q"], 0.25).withColumns({"value": rnd(F.col("value"), 6), "target": rnd(F.col("target"), 6)})


@query("n14_array_max_score", f"WITH {MANY} SELECT series_id, t, list_max(x) AS score FROM m")
def _n14(s, d):
    return S.m_points(s, d).select("series_id", "t", F.array_max("x").alias("score"))


@query("n15_mse", f"WITH {U}, {WIN} SELECT series_id, q, round({D2.format(a='v', b='list_reverse(v)')} / 4, 5) + 0.0 AS e FROM w")
def _n15(s, d):
    return u_windows(s, d).select("series_id", F.col("start").alias("q"), rnd(A.mse(F.col("w"), F.reverse("w"))).alias("e"))


# ---- windows ----
@query(
    "w01_windows",
    f"""WITH {MANY}, k AS (SELECT * FROM (SELECT series_id, t AS start, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS h FROM m) WHERE len(h) = 6),
z AS (SELECT series_id, start, flatten([list_transform(h, lambda a: a[1]), list_transform(h, lambda a: a[2]), list_transform(h, lambda a: a[3]), list_transform(h, lambda a: a[4]), list_transform(h, lambda a: a[5])]) AS w FROM k) """
    + sums_sql("series_id, start", "z"),
)
def _w01(s, d):
    return sums(W.windows(S.m_points(s, d), 6), ["series_id", "start"])


STR = "st AS (SELECT series_id, unnest(list_distinct(list_append(range(0, n - 4 + 1, 7), n - 4))) AS start FROM meta)"


@query("w02_strided_windows", f"WITH {U}, {WIN}, {STR} " + sums_sql("series_id, start", "(SELECT st.series_id, start, v AS w FROM st JOIN w ON w.series_id = st.series_id AND w.q = start)"))
def _w02(s, d):
    return sums(W.strided_windows(S.u_small(s, d), 4, 7), ["series_id", "start"])


@query("w03_patches", f"WITH {U}, {WIN}, s AS (SELECT series_id, unnest([0, 10, 500]) AS start FROM meta) SELECT s.series_id, start, round(list_sum(v), 5) AS s1 FROM s LEFT JOIN w ON w.series_id = s.series_id AND w.q = start")
def _w03(s, d):
    u = S.u_small(s, d)
    starts = u.select("series_id").distinct().select("series_id", F.explode(F.array(*[F.lit(i) for i in (0, 10, 500)])).alias("start"))
    return W.patches(u, starts, 4).select("series_id", "start", rnd(A.total(F.col("w"))).alias("s1"))


@query(
    "w04_overlap_pairs",
    f"""WITH {U}, k AS (SELECT u.series_id, t AS start, n, list(x) OVER (PARTITION BY u.series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM u JOIN meta USING (series_id)),
e AS (SELECT series_id, start, delta, w FROM k, (SELECT unnest([1, 2]) AS delta) WHERE start <= n - 8 - 2)
SELECT series_id, start, delta, round(list_sum(w[delta + 2:8 - 1]), 5) AS a, round(list_sum(w[delta + 2:delta + 8][1:8 - delta - 2]), 5) AS b FROM e""",
)
def _w04(s, d):
    return W.overlap_pairs(S.u_small(s, d), 8, [1, 2], 1).select("series_id", "start", "delta", rnd(A.total(F.col("a"))).alias("a"), rnd(A.total(F.col("b"))).alias("b"))


WSC = "sc AS (SELECT series_id, q AS start, list_sum(v) AS score FROM w)"


def win_scores(s, d) -> DataFrame:
    return u_windows(s, d).select("series_id", "start", A.total(F.col("w")).alias("score"))


@query("w05_to_points", f"WITH {U}, {WIN}, {WSC} SELECT u.series_id, t, round(avg(score), 5) AS score FROM u LEFT JOIN sc ON u.series_id = sc.series_id AND start BETWEEN t - 3 AND t GROUP BY 1, 2")
def _w05(s, d):
    return W.to_points(win_scores(s, d), 4, S.u_small(s, d)).select("series_id", "t", rnd(F.col("score")).alias("score"))


@query("w06_tokens_to_points", f"WITH {U}, {WIN}, {STR} SELECT st.series_id, start + i - 1 AS t, round(avg(v[i] * v[1]), 5) AS score FROM st JOIN w ON w.series_id = st.series_id AND w.q = start, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1, 2")
def _w06(s, d):
    w = W.strided_windows(S.u_small(s, d), 4, 7)
    return W.tokens_to_points(w.select("series_id", "start", F.transform("w", lambda x: x * F.get("w", F.lit(0))).alias("scores"))).select("series_id", "t", rnd(F.col("score")).alias("score"))


@query("w07_pad_to_points", f"WITH {U}, {WIN}, {WSC} SELECT u.series_id, t, round(score, 5) AS score FROM u JOIN meta USING (series_id) JOIN sc ON u.series_id = sc.series_id AND start = greatest(0, least(t - 2, n - 4))")
def _w07(s, d):
    return W.pad_to_points(win_scores(s, d), 4, S.u_small(s, d)).select("series_id", "t", rnd(F.col("score")).alias("score"))


ACF = """c AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) AS d FROM u), a0 AS (SELECT series_id, list(d ORDER BY t) AS a FROM c GROUP BY 1),
r AS (SELECT series_id, CAST(k AS INT) AS lag, list_sum(list_transform(list_zip(a[1:len(a) - k], a[k + 1:len(a)]), lambda z: z[1] * z[2])) / list_sum(list_transform(a, lambda z: z * z)) AS r
  FROM (SELECT series_id, a, unnest(range(0, len(a))) AS k FROM a0)),
mx AS (SELECT * FROM (SELECT *, lag(r) OVER o AS p, lead(r) OVER o AS q FROM r WHERE lag >= 3 WINDOW o AS (PARTITION BY series_id ORDER BY lag)) WHERE r > p AND r > q)"""


@query("w08_acf", f"WITH {U}, {ACF} SELECT series_id, lag, round(r, 6) + 0.0 AS r FROM r")
def _w08(s, d):
    return W.acf(S.u_small(s, d)).select("series_id", "lag", rnd(F.col("r"), 6).alias("r"))


PERIOD = """SELECT s.series_id, coalesce(CASE WHEN lag - 3 BETWEEN 3 AND 300 THEN lag END, 125) AS length FROM (SELECT DISTINCT series_id FROM u) s
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r DESC, lag) AS k FROM mx) b ON b.series_id = s.series_id AND k = {k}"""


@query("w09_estimate_window", f"WITH {U}, {ACF} " + PERIOD.format(k=1))
def _w09(s, d):
    return W.estimate_window(S.u_small(s, d))


@query("w10_period", f"WITH {U}, {ACF} " + PERIOD.format(k=2))
def _w10(s, d):
    return W.period(S.u_small(s, d), 2)


RULED = "CASE method WHEN '1-URGENT' THEN 'KMeansAD' WHEN '2-HIGH' THEN 'IForest' WHEN '3-MEDIUM' THEN 'PCA' ELSE 'LOF' END"


@query("w11_window_rule", f"WITH {UNITS}, k AS (SELECT *, {RULED} AS named FROM units) SELECT file, named, CAST(CASE WHEN track = 'U' THEN 7 WHEN named = 'KMeansAD' THEN 40 WHEN named = 'IForest' THEN 100 ELSE 1 END AS INT) AS length FROM k")
def _w11(s, d):
    return S.units(s, d).select("file", F.expr(RULED).alias("named"), W.window_rule(F.expr(RULED), F.col("track"), F.lit(7)).alias("length"))


# ---- nearest neighbours ----
PAIRS = f"pr AS (SELECT w.series_id, q, m, {D2.format(a='v', b='u')} AS d2 FROM w JOIN tr USING (series_id))"
RANK = "rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, q ORDER BY d2, m) AS place FROM pr)"
VTR = "tr AS (SELECT series_id, vec_id AS m, v AS u FROM v WHERE is_train), w AS (SELECT series_id, vec_id AS q, v FROM v)"
VPAIRS = "pr AS (SELECT w.series_id, q, m, greatest(0.0, 2 - 2 * list_sum(list_transform(list_zip(v, u), lambda z: z[1] * z[2]))) AS d2 FROM w JOIN tr USING (series_id))"


@query("j01_pairwise", f"WITH {U}, {WIN}, {SPLIT}, {PAIRS} SELECT series_id, q, m, round(d2, 4) + 0.0 AS d2 FROM pr")
def _j01(s, d):
    train, q = u_train_query(s, d)
    return J.pairwise(q, train, places=4)


@query("j02_unit_distance", f"WITH {V}, {VTR}, {VPAIRS} SELECT series_id, q, m, round(d2, 6) + 0.0 AS d2 FROM pr")
def _j02(s, d):
    train, q = vec_train_query(s, d, stored=True)
    return J.pairwise(q, train, unit=True, places=6)


@query("j03_topk_mean", f"WITH {V}, {VTR}, {VPAIRS}, {RANK} SELECT series_id, q, round(avg(d2), 6) + 0.0 AS score FROM rk WHERE place <= 3 GROUP BY 1, 2")
def _j03(s, d):
    train, q = vec_train_query(s, d)
    return J.topk_mean(q, train, 3).withColumn("score", rnd(F.col("score"), 6))


KNN = "SELECT series_id, q, round(avg(sqrt(d2)), 5) AS score FROM rk WHERE place <= {k} GROUP BY 1, 2"


@query("j04_knn_score", f"WITH {U}, {WIN}, {SPLIT}, {PAIRS}, {RANK} " + KNN.format(k=50))
def _j04(s, d):
    train, q = u_train_query(s, d)
    return J.knn_score(train, q, 50).withColumn("score", rnd(F.col("score")))


FIT_SCORE = f"""WITH {U}, sd AS (SELECT u.series_id, avg(x) AS mu, stddev_pop(x) AS sd FROM u JOIN meta USING (series_id) WHERE t < train_index GROUP BY 1),
u2 AS (SELECT u.series_id, t, (x - mu) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END AS x FROM u JOIN sd USING (series_id)),
{WIN.replace('FROM u)', 'FROM u2)')}, {SPLIT}, {PAIRS}, {RANK}, ks AS ({KNN.format(k=50).replace('round(', '(').replace(', 5)', ')')})
SELECT u.series_id, u.t, round(avg(ks.score), 5) AS score FROM u JOIN ks ON ks.series_id = u.series_id AND ks.q BETWEEN u.t - 3 AND u.t GROUP BY 1, 2"""


@query("j04_knn_fit_then_score", FIT_SCORE)
def _j04_fitted(s, d):
    # learnt and written first; points are scored from the tables in the shared folder
    u, folder = S.u_small(s, d), scratch.new_folder(s, "fitted")
    detect.fit_detector(u, folder, "knn", 4)
    return detect.score_fitted(u, folder).withColumn("score", rnd(F.col("score"))).where("score IS NOT NULL")


@query("j05_knn_repr_score", f"WITH {U}, {WIN}, {SPLIT}, {PAIRS}, {RANK} " + KNN.format(k=5))
def _j05(s, d):
    train, q = u_train_query(s, d)
    return J.knn_repr_score(train, q, 5).withColumn("score", rnd(F.col("score")))


@query("j06_min_center_distance", f"WITH {U}, {WIN}, {SPLIT}, {PAIRS} SELECT series_id, q, round(sqrt(greatest(0, min(d2))), 5) AS score FROM pr GROUP BY 1, 2")
def _j06(s, d):
    train, q = u_train_query(s, d)
    return J.min_center_distance(q, train).withColumn("score", rnd(F.col("score")))


@query("j07_assign", f"WITH {U}, {WIN}, {SPLIT}, {PAIRS}, {RANK} SELECT series_id, q, m, round(d2, 4) + 0.0 AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY series_id, q ORDER BY d2, m) AS p2 FROM pr) WHERE p2 = 1")
def _j07(s, d):
    train, q = u_train_query(s, d)
    return J.assign(q, train).withColumn("d2", rnd(F.col("d2"), 4))


@query(
    "j08_lof",
    f"""WITH {V}, {VTR}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, q ORDER BY d, m) AS place FROM
  (SELECT a.series_id, a.m AS q, b.m, sqrt({D2.format(a='a.u', b='b.u')}) AS d FROM tr a JOIN tr b ON a.series_id = b.series_id AND a.m <> b.m)) WHERE place <= 30),
kd AS (SELECT series_id, q AS m, max(d) AS kdist FROM own GROUP BY 1, 2),
lrd AS (SELECT own.series_id, own.q AS m, 1 / (avg(greatest(kdist, d)) + 1e-10) AS lrd FROM own JOIN kd ON own.series_id = kd.series_id AND own.m = kd.m GROUP BY 1, 2),
qn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, q ORDER BY d, m) AS place FROM (SELECT w.series_id, q, m, sqrt({D2.format(a='v', b='u')}) AS d FROM w JOIN tr USING (series_id))) WHERE place <= 30)
SELECT qn.series_id, qn.q, round(avg(lrd) * (avg(greatest(kdist, d)) + 1e-10), 5) AS score FROM qn JOIN kd USING (series_id, m) JOIN lrd USING (series_id, m) GROUP BY 1, 2""",
)
def _j08(s, d):
    train, q = vec_train_query(s, d)
    return J.lof(train, q, 30).withColumn("score", rnd(F.col("score")))


@query("j09_pair_density", f"WITH {V} SELECT a.series_id, round(sum(x * exp(-0.5 * x)), 4) AS density FROM (SELECT a.series_id, {D2.format(a='a.v', b='b.v')} AS x FROM v a JOIN v b ON a.series_id = b.series_id AND a.vec_id <> b.vec_id) a GROUP BY 1")
def _j09(s, d):
    return J.pair_density(vec_rows(s, d), 0.5).withColumn("density", rnd(F.col("density"), 4))


@query(
    "j10_memory_gated_score",
    f"""WITH {V}, {VTR}, pr AS (SELECT w.series_id, q, min({D2.format(a='v', b='u')}) AS least, any_value(v) AS v FROM w JOIN tr USING (series_id) GROUP BY 1, 2),
e AS (SELECT *, exp((least - max(least) OVER (PARTITION BY series_id)) * 10.0) AS e FROM pr)
SELECT series_id, q, round(e / sum(e) OVER (PARTITION BY series_id) * {D2.format(a='v', b='list_reverse(v)')} / 64, 6) + 0.0 AS score FROM e""",
)
def _j10(s, d):
    train, q = vec_train_query(s, d)
    err = q.select("series_id", "q", A.mse(F.col("v"), F.reverse("v")).alias("error"))
    return J.memory_gated_score(q, train, err, 0.1).withColumn("score", rnd(F.col("score"), 6))


@query(
    "j11_discrepancy_score",
    f"""WITH {U}, {WIN}, {SHARES}, k AS (SELECT series_id, q, -({KLD.format(a='p', b='r')} + {KLD.format(a='r', b='p')}) AS d FROM sh),
e AS (SELECT *, exp((d - max(d) OVER (PARTITION BY series_id)) * 50) AS e FROM k) SELECT series_id, q, round(e / sum(e) OVER (PARTITION BY series_id), 6) + 0.0 AS score FROM e""",
)
def _j11(s, d):
    return J.discrepancy_score(shares(s, d)).select("series_id", "q", rnd(F.col("score"), 6).alias("score"))


LOCK = "lk AS (SELECT track, dataset, max(file) AS config FROM units WHERE dataset <> 'NATION_4' GROUP BY 1, 2)"


@query("j12_bind_config", f"WITH {UNITS}, {LOCK} SELECT file, track, dataset, config FROM units JOIN lk USING (track, dataset)")
def _j12(s, d):
    u = S.units(s, d)
    return R.bind_config(u.select("file", "track", "dataset"), u.where("dataset <> 'NATION_4'").groupBy("track", "dataset").agg(F.max("file").alias("config"))).select("file", "track", "dataset", "config")


EXP = "files AS (SELECT DISTINCT track, dataset, file FROM units), ex AS (SELECT method, track, dataset, file FROM (SELECT DISTINCT method FROM units), files)"


def expected(s, d) -> tuple[DataFrame, DataFrame]:
    u = S.units(s, d)
    return u, R.expected_units(u, u.select("track", "dataset", "file").distinct())


@query("j13_expected_units", f"WITH {UNITS}, {EXP} SELECT method, track, dataset, file FROM ex")
def _j13(s, d):
    return expected(s, d)[1]


@query("j14_pending_units", f"WITH {UNITS}, {EXP} SELECT ex.* FROM ex ANTI JOIN (SELECT * FROM units WHERE error IS NULL) x ON ex.method = x.method AND ex.track = x.track AND ex.dataset = x.dataset AND ex.file = x.file")
def _j14(s, d):
    u, e = expected(s, d)
    return R.pending_units(e, u)


# ---- clustering and models ----
def lloyd_sql(rows: str, k: str, rounds: int) -> str:
    """CTEs from rows (series_id, q, v): evenly spaced seeds, Lloyd's steps; the last ones are
    the centres ``cn`` (series_id, m, u) and the rows with their centre ``an`` (.., v, m)."""
    sql = f"""sd AS (SELECT series_id, q, v, row_number() OVER (PARTITION BY series_id ORDER BY q) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n, least({k}, count(*) OVER (PARTITION BY series_id)) AS k FROM {rows}),
c0 AS MATERIALIZED (SELECT series_id, CAST(floor(r * k / n) AS INT) AS m, v AS u FROM sd WHERE ceil(floor(r * k / n) * n / k) = r)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT r.series_id, q, arg_min(v, d) AS v, arg_min(m, struct_pack(d := d, m := m)) AS m FROM (SELECT r.series_id, q, v, m, {D2.format(a='v', b='u')} AS d FROM {rows} r JOIN c{i} USING (series_id)) r GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT series_id, m, list(x ORDER BY i) AS u FROM (SELECT series_id, m, i, avg(v[i]) AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
    return sql + f""",
an AS (SELECT * FROM a{rounds}), cn AS (SELECT * FROM c{rounds + 1})"""


ROOT = "CAST(floor(sqrt(count(*) OVER (PARTITION BY series_id))) AS BIGINT)"


@query(
    "c01_kmeans_score",
    f"""WITH {V}, {VTR}, t AS (SELECT series_id, m AS q, u AS v FROM tr), {lloyd_sql('t', '10', 10)}
SELECT series_id, q, round(sqrt(min({D2.format(a='v', b='u')})), 5) AS score FROM w JOIN cn USING (series_id) GROUP BY 1, 2""",
)
def _c01(s, d):
    train, q = vec_train_query(s, d)
    return C.kmeans_score(train.select("series_id", F.col("m").alias("q"), F.col("u").alias("v")), q).withColumn("score", rnd(F.col("score")))


@query("c02_pca_score")
def _c02(s, d):
    train, q = u_train_query(s, d)
    return C.pca_score(train.select("series_id", F.col("m").alias("q"), F.col("u").alias("v")), q, 0.25)


@query("c03_coarse_cover", f"WITH {V}, {VTR}, {lloyd_sql('w', ROOT, 3)} SELECT series_id, q, m FROM an")
def _c03(s, d):
    return C.coarse_cover(vec_rows(s, d)).select("series_id", "q", "m")


MEAN = "mn AS (SELECT series_id, list(x ORDER BY i) AS c FROM (SELECT series_id, i, avg(v[i]) AS x FROM w, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)"
TWO = f"""s1 AS (SELECT series_id, v AS a FROM (SELECT w.series_id, v, row_number() OVER (PARTITION BY w.series_id ORDER BY {D2.format(a='v', b='c')} DESC, q) AS p FROM w JOIN mn USING (series_id)) WHERE p = 1),
s2 AS (SELECT series_id, a, v AS b FROM (SELECT w.series_id, v, a, row_number() OVER (PARTITION BY w.series_id ORDER BY {D2.format(a='v', b='a')} DESC, q) AS p FROM w JOIN s1 USING (series_id)) WHERE p = 1),
t0 AS MATERIALIZED (SELECT w.series_id, q, v, CAST({D2.format(a='v', b='b')} < {D2.format(a='v', b='a')} AS INT) AS side FROM w JOIN s2 USING (series_id))"""
for _i in range(1, 12):
    TWO += f""",
k{_i} AS (SELECT series_id, max(CASE WHEN side = 0 THEN c END) AS a, max(CASE WHEN side = 1 THEN c END) AS b FROM
  (SELECT series_id, side, list(x ORDER BY i) AS c FROM (SELECT series_id, side, i, avg(v[i]) AS x FROM t{_i - 1}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
t{_i} AS MATERIALIZED (SELECT t.series_id, q, v, CASE WHEN a IS NULL OR b IS NULL THEN side ELSE CAST({D2.format(a='v', b='b')} < {D2.format(a='v', b='a')} AS INT) END AS side FROM t{_i - 1} t JOIN k{_i} USING (series_id))"""
TWO += ", sp AS (SELECT * FROM t11)"


@query("c04_two_means", f"WITH {V}, {VTR}, {MEAN}, {TWO} SELECT series_id, q, side FROM sp")
def _c04(s, d):
    return C.two_means_split(vec_rows(s, d)).select("series_id", "q", "side")


SSE = "(SELECT series_id, side AS m, i, count(*) AS n, var_pop(v[i]) * count(*) AS e FROM sp, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3)"


def halves(s, d) -> tuple[DataFrame, DataFrame]:
    rows = vec_rows(s, d)
    return rows.withColumn("m", F.lit(0)), C.two_means_split(rows).withColumnRenamed("side", "m")


@query("c05_ball_sse", f"WITH {V}, {VTR}, {MEAN}, {TWO} SELECT series_id, m, max(n) AS n, CAST(64 AS INT) AS dim, round(sum(e), 5) AS sse FROM {SSE} GROUP BY 1, 2")
def _c05(s, d):
    return C.ball_sse(halves(s, d)[1]).withColumn("sse", rnd(F.col("sse")))


@query(
    "c06_bic_improves",
    f"""WITH {V}, {VTR}, {MEAN}, {TWO}, e AS (SELECT series_id, sum(e) AS sse FROM {SSE} GROUP BY 1),
p AS (SELECT series_id, any_value(n) AS n, sum(e) AS sse FROM (SELECT series_id, i, count(*) AS n, var_pop(v[i]) * count(*) AS e FROM w, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT p.series_id, n * 64 * ln(greatest(p.sse, 1e-12) / (n * 64)) + 65 * ln(greatest(2, n)) AS pb, n * 64 * ln(greatest(e.sse, 1e-12) / (n * 64)) + 131 * ln(greatest(2, n)) AS cb FROM p JOIN e USING (series_id))
SELECT series_id, round(pb, 4) AS parent_bic, round(cb, 4) AS child_bic, cb + 1e-9 < pb AS improves FROM b""",
)
def _c06(s, d):
    one, two = halves(s, d)
    return C.bic_improves(C.ball_sse(one), C.ball_sse(two)).withColumns({"parent_bic": rnd(F.col("parent_bic"), 4), "child_bic": rnd(F.col("child_bic"), 4)})


@query("c07_granular_partition")
def _c07(s, d):
    return C.granular_partition(vec_rows(s, d)).select("series_id", "q", "m")


BALLS = "bl AS (SELECT series_id, q, v, q % 3 AS m FROM w), bc AS (SELECT series_id, m, list(x ORDER BY i) AS c FROM (SELECT series_id, m, i, avg(v[i]) AS x FROM bl, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def balls(s, d) -> DataFrame:
    return vec_rows(s, d).withColumn("m", F.col("q") % 3)


@query(
    "c08_exemplar_memory",
    f"""WITH {V}, {VTR}, {BALLS}, e AS (SELECT series_id, m, q, v FROM (SELECT bl.*, row_number() OVER (PARTITION BY bl.series_id, bl.m ORDER BY {D2.format(a='v', b='c')}, q) AS p FROM bl JOIN bc USING (series_id, m)) WHERE p = 1) """
    + sums_sql("series_id, m, q", "(SELECT series_id, m, q, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS w FROM e)"),
)
def _c08(s, d):
    return sums(C.exemplar_memory(balls(s, d)), ["series_id", "m", "q"], "u")


@query(
    "c09_normalize_balls",
    f"""WITH {V}, {VTR}, {BALLS}, s AS (SELECT series_id, m, count(*) AS n, max(sqrt({D2.format(a='v', b='c')})) AS radius FROM bl JOIN bc USING (series_id, m) GROUP BY 1, 2),
k AS (SELECT *, max(n) OVER (PARTITION BY series_id) AS best, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, m) AS r FROM s)
SELECT series_id, m, n, round(radius, 5) AS radius, radius > 1.8 AS split FROM k WHERE n > 8 OR (best <= 8 AND r = 1)""",
)
def _c09(s, d):
    return C.normalize_balls(balls(s, d), 0.9).withColumn("radius", rnd(F.col("radius")))


@query(
    "c10_clean_clusters",
    f"""WITH {V}, {VTR}, {BALLS}, sd AS (SELECT series_id, m, q, CAST(CASE WHEN m = 0 THEN 1 ELSE q % 2 END AS INT) AS side FROM bl UNION ALL SELECT series_id, m, q, 0 FROM bl WHERE m = 1),
f AS (SELECT series_id, m, bool_or(c = n) AS failed FROM (SELECT series_id, m, side, count(DISTINCT q) AS c FROM sd GROUP BY 1, 2, 3) JOIN (SELECT series_id, m, count(*) AS n FROM bl GROUP BY 1, 2) USING (series_id, m) GROUP BY 1, 2)
SELECT DISTINCT series_id, m, CASE WHEN failed THEN 0 ELSE side END AS side, q FROM sd JOIN f USING (series_id, m)""",
)
def _c10(s, d):
    """Balls of class 0 lose a side, those of class 1 come whole on one side and in part on
    the other, those of class 2 fall in two."""
    b = balls(s, d)
    side = F.when(F.col("m") == 0, 1).otherwise(F.col("q") % 2).cast("int")
    split = b.withColumn("side", side).unionByName(b.where("m = 1").withColumn("side", F.lit(0)))
    return C.clean_clusters(split, b).select("series_id", "m", "side", "q")


@query(
    "c11_center_memory",
    f"""WITH {V}, {VTR}, {lloyd_sql('w', '12', 3)}, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM cn),
sl AS (SELECT series_id, CAST(unnest(CASE WHEN r = n THEN range(r, greatest(r, 12) + 1) ELSE [r] END) AS INT) AS slot, u FROM rk) """
    + sums_sql("series_id, slot", "sl", "u"),
)
def _c11(s, d):
    return sums(C.center_memory(vec_rows(s, d), 12), ["series_id", "slot"], "u")


@query("c12_iforest")
def _c12(s, d):
    train, q = vec_train_query(s, d)
    return C.iforest(train.select("series_id", F.col("m").alias("q"), F.col("u").alias("v")), q)


CC = "z AS (SELECT series_id, q, i, (x - avg(x) OVER (PARTITION BY series_id, i)) / (stddev_pop(x) OVER (PARTITION BY series_id, i) + 1e-4) AS z FROM (SELECT series_id, q, i, v[i] AS x FROM w, (SELECT unnest(range(1, 5)) AS i)))"


@query(
    "c13_cross_correlation",
    f"""WITH {U}, {WIN}, {CC}, y AS (SELECT series_id, q, 5 - i AS j, z AS y FROM z), c AS (SELECT z.series_id, i, j, avg(z * y) AS c FROM z JOIN y USING (series_id, q) GROUP BY 1, 2, 3)
SELECT series_id, round(avg(CASE WHEN i = j THEN (c - 1) * (c - 1) END), 5) AS on_diagonal, round(avg(CASE WHEN i <> j THEN c * c END), 5) AS off_diagonal FROM c GROUP BY 1""",
)
def _c13(s, d):
    w = u_windows(s, d).select("series_id", F.col("start").alias("q"), F.col("w").alias("v"))
    return C.cross_correlation(w, w.withColumn("v", F.reverse("v"))).withColumns({"on_diagonal": rnd(F.col("on_diagonal")), "off_diagonal": rnd(F.col("off_diagonal"))})


@query("c14_partition_stats", f"WITH {V}, {VTR} SELECT series_id, count(*) AS rows, count(DISTINCT q % 3) AS initial_k, count(DISTINCT q % 7) AS final_k, round(count(DISTINCT q % 7) / count(*), 6) AS memory_ratio FROM w GROUP BY 1")
def _c14(s, d):
    return C.partition_stats(balls(s, d), vec_rows(s, d).withColumn("m", F.col("q") % 7)).withColumn("memory_ratio", rnd(F.col("memory_ratio"), 6))


@query("c15_exemplar_detector")
def _c15(s, d):
    u = S.u_small(s, d)
    return C.exemplar_points(u, S.meta_of(u), 8, variance=0.95)


# ---- metrics ----
SL = "sl AS (SELECT source AS series_id, doc_id, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM documents JOIN labels USING (doc_id))"


def score_label(s, d) -> DataFrame:
    docs, lab = S.table(s, d, "documents").select("doc_id", "source", "n_chars"), S.table(s, d, "labels")
    return docs.join(lab, "doc_id").select(F.col("source").alias("series_id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


CURVE = """g AS (SELECT series_id, score, sum(label) AS p, count(*) AS n FROM {src} GROUP BY 1, 2),
cv AS (SELECT series_id, score, CAST(sum(p) OVER o AS BIGINT) AS tp, CAST(sum(n - p) OVER o AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY series_id) AS BIGINT) AS pos, CAST(sum(n - p) OVER (PARTITION BY series_id) AS BIGINT) AS neg
  FROM g WINDOW o AS (PARTITION BY series_id ORDER BY score DESC))"""
AREAS = """ar AS (SELECT *, coalesce(lag(tp) OVER o, 0) AS tp0, coalesce(lag(fp) OVER o, 0) AS fp0 FROM cv WINDOW o AS (PARTITION BY series_id ORDER BY score DESC)),
cm AS (SELECT series_id, max(pos * neg) > 0 AS ok, sum((fp - fp0) * (tp + tp0) / 2.0) / max(pos * neg) AS auc_roc, sum((tp - tp0) / pos * (tp / (tp + fp))) AS auc_pr,
  max(2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos + 1e-5)) AS best_f1 FROM ar GROUP BY 1)"""


@query("m01_score_curve", f"WITH {SL}, {CURVE.format(src='sl')} SELECT * FROM cv")
def _m01(s, d):
    return M.score_curve(score_label(s, d))


for _name, _col in (("m02_auc_roc", "auc_roc"), ("m03_auc_pr", "auc_pr"), ("m04_best_f1", "best_f1")):

    def _metric(s, d, col=_col):
        return M.curve_metrics(M.score_curve(score_label(s, d))).select("series_id", rnd(F.col(col), 6).alias(col))

    query(_name, f"WITH {SL}, {CURVE.format(src='sl')}, {AREAS} SELECT series_id, CASE WHEN ok THEN round({_col}, 6) END AS {_col} FROM cm")(_metric)


RANGE = """rkk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM {src}),
tq AS (SELECT DISTINCT rkk.series_id, score AS thr FROM rkk, (SELECT unnest(range(0, 20)) AS k) WHERE r = floor(k * (n - 1) / 19)),
re AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY min(t)) AS i, min(t) AS s, max(t) AS e FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM {src} WHERE label = 1) GROUP BY series_id, g),
pe AS (SELECT series_id, thr, row_number() OVER (PARTITION BY series_id, thr ORDER BY min(t)) AS j, min(t) AS s, max(t) AS e FROM (SELECT x.series_id, thr, t, t - row_number() OVER (PARTITION BY x.series_id, thr ORDER BY t) AS g FROM {src} x JOIN tq USING (series_id) WHERE score >= thr) GROUP BY series_id, thr, g),
rc AS (SELECT series_id, thr, avg(CASE WHEN n > 0 THEN 0.2 ELSE 0 END + 0.8 * CASE WHEN n > 1 THEN 1.0 / n ELSE 1.0 END * c / l) AS recall FROM
  (SELECT re.series_id, tq.thr, re.i, any_value(re.e - re.s + 1) AS l, count(pe.j) AS n, sum(CASE WHEN pe.j IS NULL THEN 0 ELSE least(pe.e, re.e) - greatest(pe.s, re.s) + 1 END) AS c
   FROM re JOIN tq USING (series_id) LEFT JOIN pe ON pe.series_id = re.series_id AND pe.thr = tq.thr AND pe.s <= re.e AND pe.e >= re.s GROUP BY 1, 2, 3) GROUP BY 1, 2),
pc AS (SELECT series_id, thr, avg(CASE WHEN n > 1 THEN 1.0 / n ELSE 1.0 END * c / l) AS precision_ FROM
  (SELECT pe.series_id, pe.thr, pe.j, any_value(pe.e - pe.s + 1) AS l, count(re.i) AS n, sum(CASE WHEN re.i IS NULL THEN 0 ELSE least(pe.e, re.e) - greatest(pe.s, re.s) + 1 END) AS c
   FROM pe LEFT JOIN re ON pe.series_id = re.series_id AND pe.s <= re.e AND pe.e >= re.s GROUP BY 1, 2, 3) GROUP BY 1, 2),
rf AS (SELECT series_id, max(CASE WHEN recall + precision_ > 0 THEN 2 * recall * precision_ / (recall + precision_) ELSE 0 END) AS range_f1 FROM rc JOIN pc USING (series_id, thr) GROUP BY 1)"""


@query("m05_range_f1", f"WITH {LONG}, lx AS (SELECT series_id, t, abs(x - 50) AS score, label FROM l), {RANGE.format(src='lx')} SELECT series_id, round(range_f1, 6) AS range_f1 FROM rf")
def _m05(s, d):
    u = S.u_points(s, d).withColumn("score", F.abs(F.col("x") - 50))
    return M.range_f1(u).withColumn("range_f1", rnd(F.col("range_f1"), 6))


RANGE_ALL = RANGE[RANGE.index("\nre AS") + 1 :]


@query(
    "m05_range_f1_every_score",
    f"WITH {U}, ux AS (SELECT series_id, t, abs(x - 50) AS score, label FROM u), tq AS (SELECT DISTINCT series_id, score AS thr FROM ux), {RANGE_ALL.format(src='ux')} SELECT series_id, round(range_f1, 6) AS range_f1 FROM rf",
)
def _m05_every(s, d):
    u = S.u_small(s, d).withColumn("score", F.abs(F.col("x") - 50))
    return sweep.every_range_f1(u).select("series_id", rnd(F.col("range_f1"), 6).alias("range_f1"))


def scored_u(s, d) -> DataFrame:
    return S.u_small(s, d).select("series_id", "t", (F.col("x") + F.col("t") / 100000).alias("score"), "label")


SCORED = "sc AS (SELECT series_id, t, x + t / 100000 AS score, label FROM u)"
VUS = """rv AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM sc),
th AS (SELECT DISTINCT rv.series_id, score AS thr FROM rv, (SELECT unnest(range(0, 250)) AS k) WHERE r = floor(k * (n - 1) / 249)),
ds AS (SELECT a.series_id, a.t, a.score, a.label, min(abs(a.t - b.t)) AS d FROM sc a LEFT JOIN sc b ON a.series_id = b.series_id AND b.label = 1 GROUP BY 1, 2, 3, 4),
so AS (SELECT *, CASE WHEN label = 1 THEN 1.0 WHEN d <= l / 2 THEN sqrt(1 - d / l) ELSE 0 END AS soft FROM ds, (SELECT unnest(range(0, {length} + 1)) AS l)),
rg AS (SELECT series_id, l, gid, max(score) AS top FROM (SELECT *, t - row_number() OVER (PARTITION BY series_id, l ORDER BY t) AS gid FROM so WHERE soft > 0) GROUP BY 1, 2, 3),
ex AS (SELECT rg.series_id, l, thr, avg(CAST(top >= thr AS INT)) AS exist FROM rg JOIN th USING (series_id) GROUP BY 1, 2, 3),
ct AS (SELECT so.series_id, l, thr, (sum(label) + sum(soft)) / 2 AS p, count(*) AS n, sum(CASE WHEN score >= thr THEN soft ELSE 0 END) AS tp, count(*) FILTER (WHERE score >= thr) AS pred FROM so JOIN th USING (series_id) GROUP BY 1, 2, 3),
rt AS (SELECT ct.series_id, ct.l, ct.thr, least(tp / p, 1.0) * exist AS tpr, (pred - tp) / (n - p) AS fpr, tp / pred AS prec FROM ct JOIN ex USING (series_id, l, thr)),
lg AS (SELECT *, coalesce(lag(tpr) OVER o, 0) AS tpr0, coalesce(lag(fpr) OVER o, 0) AS fpr0 FROM rt WINDOW o AS (PARTITION BY series_id, l ORDER BY thr DESC)),
la AS (SELECT series_id, l, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc, sum((tpr - tpr0) * prec) AS pr FROM lg GROUP BY 1, 2)"""


@query("m06_vus", f"WITH {U}, {SCORED}, {VUS.format(length=4)} SELECT series_id, round(avg(roc), 6) AS vus_roc, round(avg(pr), 6) AS vus_pr FROM la GROUP BY 1")
def _m06(s, d):
    return M.vus(scored_u(s, d), 4).select("series_id", rnd(F.col("vus_roc"), 6).alias("vus_roc"), rnd(F.col("vus_pr"), 6).alias("vus_pr"))


@query("m07_segments", f"WITH {U}, o AS (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM u WHERE label = 1), r AS (SELECT series_id, min(t) AS s, max(t) AS e FROM o GROUP BY series_id, g) SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY s) AS INT) AS segment, s, e FROM r")
def _m07(s, d):
    return M.segments(S.u_small(s, d))


def six_sql(src: str, length: int, places: int) -> str:
    """The six metrics of ``src`` (series_id, t, score, label), also known as ``sc``."""
    r = lambda x, n: f"round({x}, {places}) AS {n}"
    return f"""{CURVE.format(src=src)}, {AREAS}, {RANGE.format(src=src)}, {VUS.format(length=length)}, vs AS (SELECT series_id, avg(roc) AS vr, avg(pr) AS vp FROM la GROUP BY 1)
SELECT cm.series_id, {r('vp', 'vus_pr')}, {r('vr', 'vus_roc')}, {r('range_f1', 'range_f1')}, {r('CASE WHEN ok THEN auc_pr END', 'auc_pr')}, {r('CASE WHEN ok THEN auc_roc END', 'auc_roc')}, {r('CASE WHEN ok THEN best_f1 END', 'best_f1')},
coalesce(ok AND isfinite(vp) AND isfinite(vr) AND isfinite(range_f1), false) AS finite FROM cm LEFT JOIN rf USING (series_id) LEFT JOIN vs USING (series_id)"""


@query("m08_evaluate", f"WITH {U}, sc AS (SELECT series_id, t, CASE WHEN t % 50 = 7 THEN 1.7976931348623157e308 WHEN t % 50 = 8 OR t % 50 = 9 THEN 0 ELSE x + t / 100000 END AS score, label FROM u), {six_sql('sc', 10, 6)}")
def _m08(s, d):
    """Every fiftieth score is infinite, one as often no number."""
    t = F.col("t") % 50
    odd = F.when(t == 7, float("inf")).when(t == 8, float("-inf")).when(t == 9, float("nan")).otherwise(F.col("score"))
    out = M.evaluate(scored_u(s, d).withColumn("score", odd))
    return out.withColumns({m: rnd(F.col(m), 6) for m in R.METRICS})


@query("m09_series_profile", f"WITH {U} SELECT series_id, count(*) AS points, 1 AS channels, count(*) FILTER (WHERE t < train_index AND label = 1) AS prefix_anomalies FROM u JOIN meta USING (series_id) GROUP BY 1")
def _m09(s, d):
    u = S.u_small(s, d)
    return M.series_profile(u, S.meta_of(u))


# ---- records ----
VALID = "error IS NULL AND seed = 2026"


@query("a01_valid_units", f"WITH {UNITS} SELECT file, method FROM units WHERE {VALID}")
def _a01(s, d):
    return R.valid_units(S.units(s, d)).select("file", "method")


@query("a02_match_identity", f"WITH {UNITS} SELECT file, (CASE WHEN CAST(file AS BIGINT) % 5 = 0 THEN 1 ELSE 2026 END = seed AND CASE WHEN CAST(file AS BIGINT) % 7 = 0 THEN 'x' ELSE error END IS NOT DISTINCT FROM error) AS matches FROM units")
def _a02(s, d):
    u, f = S.units(s, d), F.col("file").cast("bigint")
    e = u.withColumn("seed", F.when(f % 5 == 0, 1).otherwise(F.col("seed"))).withColumn("error", F.when(f % 7 == 0, "x").otherwise(F.col("error")))
    return R.match_identity(u, e, R.KEY, ["seed", "error"]).select("file", "matches")


@query(
    "a03_audit",
    f"""WITH {UNITS}, {EXP}, gt AS (SELECT method, track, dataset, file, count(*) AS n, count(*) FILTER (WHERE {VALID}) AS v FROM units GROUP BY 1, 2, 3, 4),
j AS (SELECT coalesce(gt.method, ex.method) AS method, ex.method IS NOT NULL AS want, n, v FROM gt FULL JOIN ex ON gt.method = ex.method AND gt.track = ex.track AND gt.dataset = ex.dataset AND gt.file = ex.file)
SELECT method, count(*) FILTER (WHERE want) AS expected, count(*) FILTER (WHERE want AND v > 0) AS valid, count(*) FILTER (WHERE want AND v = 0) AS failed, count(*) FILTER (WHERE want AND n IS NULL) AS missing,
count(*) FILTER (WHERE NOT want) AS unexpected, count(*) FILTER (WHERE n > 1) AS duplicated FROM j GROUP BY 1""",
)
def _a03(s, d):
    return R.audit(*expected(s, d))


@query("a04_audit_roots", f"WITH {UNITS} SELECT method, count(DISTINCT track) AS roots, count(*) AS units, count(DISTINCT track) = 1 AS single FROM units WHERE NOT (track = 'M' AND method = '5-LOW') GROUP BY 1")
def _a04(s, d):
    u = S.units(s, d)
    return R.audit_roots(a=u.where("track = 'U'"), b=u.where("track = 'M' and method <> '5-LOW'"))


@query("a05_duplicates", f"WITH {UNITS} SELECT method, dataset, count(*) AS n FROM units GROUP BY 1, 2 HAVING count(*) > 1")
def _a05(s, d):
    return R.duplicates(S.units(s, d), ["method", "dataset"])


@query(
    "a06_key_diff",
    f"WITH {UNITS}, {EXP} SELECT method, file, 'missing' AS side FROM (SELECT DISTINCT method, file FROM ex EXCEPT SELECT method, file FROM units) UNION ALL SELECT method, file, 'unexpected' FROM (SELECT method, file FROM units EXCEPT SELECT method, file FROM ex)",
)
def _a06(s, d):
    u, e = expected(s, d)
    return R.key_diff(e, u, ["method", "file"])


@query("a07_files_per_track", f"WITH {UNITS} SELECT track, count(DISTINCT file) AS files, count(DISTINCT file) = 1 AS single FROM units GROUP BY 1")
def _a07(s, d):
    return R.files_per_track(S.units(s, d))


@query("a08_forbidden_keys", "SELECT event_id, 'k' AS key FROM events WHERE props LIKE '%\"k\"%'")
def _a08(s, d):
    return R.forbidden_keys(S.table(s, d, "events"), "props", ["k", "scores"]).select("event_id", "key")


@query("a08_key_paths", """SELECT event_id, 'k' AS key, path FROM events, (SELECT unnest(['$.props.k', '$.all[0].k', '$.all[1][0].k']) AS path) WHERE props LIKE '%"k"%'""")
def _a08_paths(s, d):
    # the events' own JSON as a value, in arrays, and as the text of a string (no key there)
    text = F.concat(F.lit('{"props":'), "props", F.lit(',"all":['), "props", F.lit(",["), "props", F.lit("]],"), F.expr("substr(to_json(struct(props AS note)), 2)"))
    return R.key_paths(S.table(s, d, "events").select("event_id", text.alias("text")), ["event_id"], "text", ["k", "scores"])


RM = ", ".join(f"round({m}, 12) AS {m}" for m in R.METRICS)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: rnd(F.col(m), 12) for m in R.METRICS})


@query("a09_summarize", f"WITH {UNITS} SELECT track, dataset, method, {RM}, n FROM (SELECT track, dataset, method, {MEANS}, count(*) AS n FROM units WHERE {VALID} GROUP BY 1, 2, 3)")
def _a09(s, d):
    return rounded(R.summarize(R.valid_units(S.units(s, d)), ["track", "dataset", "method"]))


@query("a10_method_means", f"WITH {UNITS} SELECT method, {RM}, memory_ratio, query_ms_per_patch, series FROM (SELECT method, {MEANS}, round(avg(vus_pr / 2), 9) AS memory_ratio, round(avg(auc_roc * 3), 9) AS query_ms_per_patch, count(DISTINCT (track, dataset, file)) AS series FROM units GROUP BY 1)")
def _a10(s, d):
    u = S.units(s, d).withColumns({"memory_ratio": F.col("vus_pr") / 2, "query_ms_per_patch": F.col("auc_roc") * 3})
    return rounded(R.method_means(u)).withColumns({c: rnd(F.col(c), 9) for c in ("memory_ratio", "query_ms_per_patch")})


HEAD = "'| Method | VP | AR |' || chr(10) || '| --- | --- | --- |' || chr(10)"


@query(
    "a11_render",
    f"""WITH {UNITS}, m AS (SELECT dataset, method, avg(vus_pr) + 1e-9 AS a, avg(auc_roc) + 1e-9 AS b FROM units GROUP BY 1, 2)
SELECT dataset, {HEAD} || string_agg('| ' || method || ' | ' || printf('%.3f', a) || ' | ' || printf('%.3f', b) || ' |', chr(10) ORDER BY method) AS body FROM m GROUP BY 1""",
)
def _a11(s, d):
    m = R.summarize(S.units(s, d), ["dataset", "method"]).withColumns({c: F.col(c) + 1e-9 for c in R.METRICS})  # no ties in rounding
    rows = R.render(m, ["dataset", "method"], {"VP": "vus_pr", "AR": "auc_roc"})
    return R.markdown(rows.withColumn("row", F.regexp_replace("row", r"^\| [^|]* \|", "|")), "dataset", ["Method", "VP", "AR"])


@query("a12_status", f"WITH {UNITS} SELECT count(*) AS records, count(*) FILTER (WHERE {VALID}) AS valid, count(*) FILTER (WHERE error IS NOT NULL) AS errors, count(*) FILTER (WHERE {VALID}) = count(*) AS complete FROM units")
def _a12(s, d):
    return R.status(S.units(s, d))


GRID = "gr AS (SELECT profile, lr, k, p FROM (SELECT DISTINCT n_name AS profile FROM nation), (SELECT unnest([1, 2, 3]) AS lr), (SELECT unnest([5, 10, 20]) AS k), (SELECT 64 AS p))"


def grid(s, d) -> DataFrame:
    profiles = S.table(s, d, "nation").select(F.col("n_name").alias("profile")).distinct()
    return R.candidate_grid(profiles, {"lr": [1, 2, 3], "k": [5, 10, 20]}, {"p": 64})


@query("a13_candidate_grid", f"WITH {GRID} SELECT * FROM gr")
def _a13(s, d):
    return grid(s, d)


@query(
    "a14_sample_candidates",
    f"""WITH {GRID} SELECT CAST(row_number() OVER (ORDER BY dflt, h) - 1 AS INT) AS trial, profile, lr, k, p FROM
(SELECT *, CASE WHEN profile = 'NATION_4' AND lr = 1 AND k = 5 THEN 0 ELSE 1 END AS dflt, md5('2026:' || profile || ',' || lr || ',' || k || ',' || p) AS h FROM gr) ORDER BY dflt, h LIMIT 24""",
)
def _a14(s, d):
    return R.sample_candidates(grid(s, d), 24, "2026", (F.col("profile") == "NATION_4") & (F.col("lr") == 1) & (F.col("k") == 5))


TR = f"tr AS (SELECT track, dataset, CAST(CAST(file AS BIGINT) % 6 AS BIGINT) AS trial, {MEANS} FROM units WHERE {VALID} GROUP BY 1, 2, 3)"


def trials(s, d) -> DataFrame:
    return R.valid_units(S.units(s, d)).withColumn("trial", F.col("file").cast("bigint") % 6)


BEST = f"""SELECT * EXCLUDE (r, o) FROM (SELECT *, row_number() OVER (PARTITION BY track, dataset ORDER BY objective DESC, round(vus_pr, 9) DESC, round(vus_roc, 9) DESC, round(range_f1, 9) DESC, trial) AS r FROM
(SELECT *, o AS objective FROM (SELECT *, round(({' + '.join(R.METRICS)}) / 6, 9) AS o FROM tr))) WHERE r = 1"""


@query("a15_select_trial", f"WITH {UNITS}, {TR} SELECT track, dataset, trial, round(objective, 6) AS objective FROM ({BEST})")
def _a15(s, d):
    return R.select_trial(trials(s, d), ["track", "dataset"]).select("track", "dataset", "trial", rnd(F.col("objective"), 6).alias("objective"))


@query("a16_missing_trials", f"WITH {UNITS} SELECT dataset, trial FROM (SELECT DISTINCT dataset, t AS trial FROM units, (SELECT unnest(range(0, 200)) AS t)) EXCEPT SELECT dataset, CAST(file AS BIGINT) % 200 FROM units")
def _a16(s, d):
    u = S.units(s, d)
    want = u.select("dataset").distinct().select("dataset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(199).cast("bigint"))).alias("trial"))
    return R.missing_trials(u.select("dataset", (F.col("file").cast("bigint") % 200).alias("trial")), want, ["dataset", "trial"])


@query(
    "a17_freeze",
    f"""WITH {UNITS}, {TR}, b AS ({BEST}) SELECT sha256(string_agg(j, chr(10) ORDER BY j)) AS fingerprint, count(*) AS n FROM (SELECT '{{"dataset":"' || dataset || '","track":"' || track || '","trial":' || trial || '}}' AS j FROM b)""",
)
def _a17(s, d):
    return R.freeze(R.select_trial(trials(s, d), ["track", "dataset"]).select("track", "dataset", "trial"))


WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR) AS w{i}" for i in range(8))


@query(
    "a17_freeze_ranges",
    f"""WITH r AS (SELECT CAST('0x' || substr(sha256('{{"o_orderkey":' || o_orderkey || '}}'), 1, 8) AS BIGINT) % 256 AS part,
  sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders),
s AS (SELECT part, count(*) AS n, {WORDS} FROM r GROUP BY 1)
SELECT part, n, sha256(concat_ws(',', CAST(n AS VARCHAR), {', '.join(f'w{i}' for i in range(8))})) AS fingerprint FROM s""",
)
def _a17_ranges(s, d):
    return R.freeze_ranges(S.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


MACRO = f"mm AS (SELECT CASE WHEN grouping(track) = 1 THEN 'all' WHEN grouping(dataset) = 1 THEN 'track' ELSE 'subset' END AS grain, method, track, dataset, {MEANS} FROM units GROUP BY GROUPING SETS ((method), (method, track), (method, track, dataset)))"


@query("a18_macro_means", f"WITH {UNITS}, {MACRO} SELECT grain, method, track, dataset, {RM} FROM mm")
def _a18(s, d):
    return rounded(R.macro_means(S.units(s, d)))


CELLS = f"""lo AS (UNPIVOT (SELECT grain, method, track, dataset, {', '.join(f'round({m}, 9) AS {m}' for m in R.METRICS)} FROM mm) ON {', '.join(R.METRICS)} INTO NAME metric VALUE value),
bs AS (SELECT grain, track, dataset, metric, method AS baseline, value FROM (SELECT *, row_number() OVER (PARTITION BY grain, track, dataset, metric ORDER BY value DESC, method) AS r FROM lo WHERE method <> '1-URGENT') WHERE r = 1),
ce AS (SELECT bs.*, lo.value AS target_value, lo.value - bs.value AS delta, lo.value > bs.value AS win FROM bs JOIN lo ON lo.method = '1-URGENT' AND lo.grain = bs.grain AND lo.track IS NOT DISTINCT FROM bs.track AND lo.dataset IS NOT DISTINCT FROM bs.dataset AND lo.metric = bs.metric)"""


def cells(s, d) -> DataFrame:
    means = R.macro_means(S.units(s, d))
    return R.best_baseline(means.withColumns({m: F.round(m, 9) for m in R.METRICS}), "1-URGENT")


@query("a19_best_baseline", f"WITH {UNITS}, {MACRO}, {CELLS} SELECT grain, track, dataset, metric, baseline, round(value, 6) AS value, round(target_value, 6) AS target_value, round(delta, 6) + 0.0 AS delta, win FROM ce")
def _a19(s, d):
    return cells(s, d).withColumns({c: rnd(F.col(c), 6) for c in ("value", "target_value", "delta")})


@query("a20_gate", f"WITH {UNITS}, {MACRO}, {CELLS} SELECT grain, count(*) FILTER (WHERE win) AS wins, count(*) AS cells, bool_and(win) AS passed FROM ce WHERE grain IN ('all', 'track') GROUP BY 1")
def _a20(s, d):
    return R.gate(cells(s, d))


@query(
    "a22_phase_barrier",
    f"""WITH {UNITS}, au AS (SELECT method, bool_and({VALID}) AS done FROM units GROUP BY 1), ok AS (SELECT bool_and(done) AS done FROM au)
SELECT 'all' AS phase, file FROM units WHERE (SELECT done FROM ok) UNION ALL SELECT 'valid' AS phase, file FROM units""",
)
def _a22(s, d):
    """All units behind the audit of all of them (closed if one has failed), and behind the
    audit of the valid ones (open)."""
    u = S.units(s, d)
    good = R.valid_units(u)
    rows = lambda done, name: R.phase_barrier(u.select("file"), R.audit(done, done)).select(F.lit(name).alias("phase"), "file")
    return rows(u, "all").unionByName(rows(good, "valid"))


@query(
    "a21_continuation",
    f"""WITH {UNITS}, m AS (SELECT method, dataset, avg(vus_pr) AS v, count(*) FILTER (WHERE {VALID}) AS n, md5(method || dataset) AS fp FROM units GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n % 5 = 0 THEN 2027 ELSE 2026 END AS seed, v > 0.4 AS passed, 6 AS gw, 6 AS gc, CASE WHEN n % 3 = 0 THEN 11 ELSE 12 END AS tw, 12 AS tc FROM m),
lk AS (SELECT DISTINCT fp FROM m WHERE dataset <> 'NATION_4')
SELECT method, dataset, passed AND seed = 2026 AND tw = 12 AND r.fp IN (SELECT fp FROM lk) AS may_continue FROM r""",
)
def _a21(s, d):
    m = S.units(s, d).groupBy("method", "dataset").agg(F.avg("vus_pr").alias("v"), F.count_if(R.valid()).alias("n"))
    m = m.withColumn("fingerprint", F.md5(F.concat("method", "dataset").cast("binary")))
    report = m.withColumns(
        {"seed": F.when(F.col("n") % 5 == 0, 2027).otherwise(2026), "passed": F.col("v") > 0.4, "global_wins": F.lit(6), "global_cells": F.lit(6), "track_wins": F.when(F.col("n") % 3 == 0, 11).otherwise(12), "track_cells": F.lit(12)}
    )
    return R.continuation(report, m.where("dataset <> 'NATION_4'").select("fingerprint")).select("method", "dataset", "may_continue")


@query("a23_normalize_units", f"WITH {UNITS} SELECT CASE WHEN CAST(file AS BIGINT) % 2 = 0 THEN method ELSE 'm:' || method END AS method, track, dataset, file FROM units")
def _a23(s, d):
    u, even = S.units(s, d), F.col("file").cast("bigint") % 2 == 0
    raw = u.select(F.when(even, F.col("method")).alias("method"), F.array(F.concat(F.lit("m:"), "method")).alias("methods"), F.lower("track").alias("track"), F.col("dataset").alias("data"), F.col("file").alias("file_name"))
    return R.normalize_units(raw)


@query("a24_evidence", f"WITH {UNITS} SELECT method, track, dataset, file, seed, error FROM units")
def _a24(s, d):
    return R.evidence(S.units(s, d).withColumn("runtime_s", F.rand(1)), ("runtime_s", *R.METRICS))


@query("a25_effective_steps", f"WITH {U} SELECT series_id, CAST(CASE WHEN n < 2 * 40 THEN least(2, ceil(n / 40)) ELSE 2 END AS BIGINT) AS steps FROM meta")
def _a25(s, d):
    return S.meta_of(S.u_small(s, d)).select("series_id", R.effective_steps(F.lit(2).cast("bigint"), F.col("n"), F.lit(40)).cast("bigint").alias("steps"))


@query("a26_validate_config", "SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size > 5 THEN 'size' END, CASE WHEN NOT p_retailprice < 1500 THEN 'price' END) AS failed FROM part")
def _a26(s, d):
    return R.validate_config(S.table(s, d, "part"), {"size": F.col("p_size") > 5, "price": F.col("p_retailprice") < 1500}).select("p_partkey", "failed")


# ---- end to end ----
FLAG = f"""{U}, sca AS (SELECT series_id, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS std FROM u JOIN meta USING (series_id) WHERE t < train_index GROUP BY 1),
z AS (SELECT series_id, t, (x - mean) / std AS x FROM u JOIN sca USING (series_id)),
w AS (SELECT * FROM (SELECT series_id, t AS q, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS v FROM z) WHERE len(v) = 4), {SPLIT}, {PAIRS}, {RANK},
kn AS (SELECT series_id, q, avg(sqrt(d2)) AS score FROM rk WHERE place <= 50 GROUP BY 1, 2),
sc AS (SELECT u.series_id, t, any_value(label) AS label, round(avg(score), 9) AS score FROM u LEFT JOIN kn ON u.series_id = kn.series_id AND q BETWEEN t - 3 AND t GROUP BY 1, 2)"""


@query("flagship_detect_and_evaluate", f"WITH {FLAG}, {six_sql('sc', 10, 4)}")
def flagship(s, d):
    out = detect.detect_and_evaluate(S.u_small(s, d), "knn", 4)
    return out.withColumns({m: rnd(F.col(m), 4) for m in R.METRICS})


# ---- files: each query writes what it then reads, in the cluster's shared folder ----
def points_with_labels(s, d) -> DataFrame:
    """The ten series of five channels with a label column, as wide rows."""
    m = S.m_points(s, d)
    return m.select("series_id", "t", *[F.col("x")[i].alias(f"c{i}") for i in range(5)], (F.col("x")[1] > 90).cast("int").alias("Label"))


def written_csv(s, d) -> str:
    """One CSV a series, its lines in the order of time."""
    path = scratch.new_folder(s, "series")
    wide = points_with_labels(s, d).repartition("series_id").sortWithinPartitions("series_id", "t")
    wide.withColumn("of", F.col("series_id")).drop("series_id", "t").write.partitionBy("of").option("header", True).csv(path)
    return path


CSV = f"mm AS (SELECT series_id, t, x, CAST(x[2] > 90 AS INT) AS label FROM m)"


@query("s01_scan_series", f"WITH {MANY} SELECT CAST(series_id AS VARCHAR) AS series_id, t, round(list_sum(x), 5) AS s, CAST(len(x) AS INT) AS channels FROM m")
def _s01(s, d):
    out = S.scan_series(s, written_csv(s, d) + "/*/*.csv", "Label", folder=True)
    return out.select(F.split("series_id", "=")[1].alias("series_id"), "t", rnd(A.total(F.col("x"))).alias("s"), F.size("x").alias("channels"))


@query("s02_scan_labels", f"WITH {MANY}, {CSV} SELECT CAST(series_id AS VARCHAR) AS series_id, t, label FROM mm")
def _s02(s, d):
    return S.scan_labels(s, written_csv(s, d) + "/*/*.csv", folder=True).withColumn("series_id", F.split("series_id", "=")[1])


@query("s06_scan_json_manifest", f"WITH {UNITS} SELECT DISTINCT file || '.csv' AS file_name FROM units WHERE track = 'U'")
def _s06(s, d):
    path = scratch.new_folder(s, "manifest")
    files = S.units(s, d).where("track = 'U'").select("dataset", F.concat("file", F.lit(".csv")).alias("f"))
    files.union(files).groupBy("dataset").agg(F.collect_list("f").alias("files")).write.json(path)  # every file twice
    return S.scan_json_manifest(s, path, multi_line=False)


@query("s07_scan_units", f"WITH {UNITS} SELECT method, track, dataset, file, seed, error, {', '.join(f'round({m}, 6) AS {m}' for m in R.METRICS)} FROM units")
def _s07(s, d):
    path, u = scratch.new_folder(s, "units"), S.units(s, d)
    metrics = F.create_map(*[x for m in R.METRICS for x in (F.lit(m), F.col(m))])
    tree = u.select("*", metrics.alias("metrics"), F.col("method").alias("of"), F.col("track").alias("on")).drop(*R.METRICS)
    tree.repartition("of", "on").write.partitionBy("of", "on").json(path)
    return R.scan_units(s, path, multi_line=False).select("method", "track", "dataset", "file", "seed", "error", *[rnd(F.col(m), 6).alias(m) for m in R.METRICS])


@query("s08_write_reports", f"WITH {UNITS} SELECT track, method, {', '.join(f'round({m}, 9) AS {m}' for m in R.METRICS)}, n FROM (SELECT track, method, {MEANS}, count(*) AS n FROM units GROUP BY 1, 2)")
def _s08(s, d):
    path = scratch.new_folder(s, "reports")
    R.write_reports(S.units(s, d), path)
    back = s.read.option("header", True).csv(f"{path}/tracks")
    return back.select("track", "method", *[rnd(F.col(m).cast("double"), 9).alias(m) for m in R.METRICS], F.col("n").cast("bigint").alias("n"))


@query("s10_write_scores", f"WITH {U} SELECT series_id, t, round(x, 6) AS score FROM u")
def _s10(s, d):
    path = scratch.new_folder(s, "scores")
    R.write_scores(S.u_small(s, d).select((F.col("series_id") % 10).alias("series_id"), F.col("series_id").alias("user"), "t", F.col("x").alias("score")), path)
    return s.read.parquet(path).select(F.col("user").alias("series_id"), "t", rnd(F.col("score"), 6).alias("score"))


def written_texts(s, d) -> str:
    path = scratch.new_folder(s, "artifacts")
    lines = S.units(s, d).select("dataset", F.concat_ws(",", "method", "file").alias("value"))
    lines.repartition("dataset").sortWithinPartitions("dataset", "value").write.partitionBy("dataset").text(path)
    return path


@query("s11_hash_files", f"WITH {UNITS} SELECT dataset, CAST(sum(length(method || ',' || file) + 1) AS BIGINT) AS length, sha256(string_agg(method || ',' || file, chr(10) ORDER BY method || ',' || file) || chr(10)) AS sha256 FROM units GROUP BY 1")
def _s11(s, d):
    got = R.hash_files(s, written_texts(s, d), "*.txt")
    return got.select(F.regexp_extract("path", "dataset=([^/]+)/", 1).alias("dataset"), "length", "sha256")


@query("s12_audit_artifacts", f"WITH {UNITS} SELECT DISTINCT dataset FROM units")
def _s12(s, d):
    return R.audit_artifacts(s, written_texts(s, d), [".txt"], ["_SUCCESS.old"]).select(F.regexp_extract("path", "dataset=([^/]+)/", 1).alias("dataset"))


@query("f14_label_blind", f"WITH {U} SELECT series_id, count(*) AS points, sum(label) > 0 AS caught FROM u GROUP BY 1")
def _f14(s, d):
    """Scores whose plan is checked before they are counted, beside a wide plan that the check
    must refuse: scores that leave out what is labelled."""
    u = S.u_small(s, d)
    scores = detect.point_scores(u)
    P.assert_label_blind(scores)
    wide = u.select("*", *[(F.col("x") + i).alias(f"c{i}") for i in range(40)]).where("label = 1")
    try:
        P.assert_label_blind(wide)
        refused = F.lit(False)
    except ValueError:
        refused = F.coalesce(F.col("n") > 0, F.lit(False))
    labelled = wide.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return scores.groupBy("series_id").agg(F.count(F.lit(1)).alias("points")).join(labelled, "series_id", "left").select("series_id", "points", refused.alias("caught"))
