"""Result records: audits, ranking, comparison, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

METRICS = ["vus_pr", "vus_roc", "range_f1", "auc_pr", "auc_roc", "best_f1"]
KEY = ["method", "track", "dataset", "file"]
#: Keys that meet in one task.
KEYS = 1 << 20


def finite(*cols: str) -> Column:
    """All given metrics are numbers and finite."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in cols]
    return F.coalesce(reduce(lambda a, b: a & b, ok), F.lit(False))


def valid(seed: int = 2026) -> Column:
    return F.col("error").isNull() & finite(*METRICS) & (F.col("seed") == seed)


def valid_units(units: DataFrame, seed: int = 2026) -> DataFrame:
    """Records without error, with six finite metrics and the right seed."""
    return units.where(valid(seed))


def match_identity(units: DataFrame, expected: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """Records with ``matches``: every column of ``same`` equals the expected row's
    (null equals null)."""
    e = expected.select(*key, *[F.col(c).alias(f"_{c}") for c in same])
    return units.join(e, key).withColumn("matches", reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])).drop(*[f"_{c}" for c in same])


def audit(units: DataFrame, expected: DataFrame, seed: int = 2026) -> DataFrame:
    """By method, how many units are expected, valid, in error, missing, unexpected
    or there twice.  Records are added up by key first, so one key is one row."""
    got = units.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.count_if(valid(seed)).alias("_v"))
    j = got.join(expected.select(*KEY).distinct().withColumn("_e", F.lit(True)), KEY, "full_outer")
    want, seen = F.col("_e").isNotNull(), F.col("_n").isNotNull()
    return j.groupBy("method").agg(
        F.count_if(want).alias("expected"), F.count_if(want & (F.col("_v") > 0)).alias("valid"), F.count_if(want & seen & (F.col("_v") == 0)).alias("failed"),
        F.count_if(want & ~seen).alias("missing"), F.count_if(~want & seen).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("duplicated"),
    )


def audit_roots(**roots: DataFrame) -> DataFrame:
    """(method, roots, units, single): a method must live in exactly one root."""
    every = reduce(DataFrame.unionByName, [df.select("method").withColumn("root", F.lit(name)) for name, df in roots.items()])
    out = every.groupBy("method").agg(F.count_distinct("root").alias("roots"), F.count(F.lit(1)).alias("units"))
    return out.withColumn("single", F.col("roots") == 1)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """A05."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_diff(expected: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Keys with ``side`` missing or unexpected; null equals null.  The keys of both are
    written once and meet in as many parts as their number asks for."""
    sides = [df.select(*key, F.lit(i).alias("_s")) for i, df in ((1, expected), (2, seen))]
    both = written(sides[0].unionByName(sides[1]), "keys")
    dealt = both.repartition(max(1, -(-both.count() // KEYS)), *key)
    met = dealt.groupBy(*key).agg(F.bit_or("_s").alias("_s")).where("_s < 3")
    return met.select(*key, F.when(F.col("_s") == 1, "missing").otherwise("unexpected").alias("side"))


def files_per_track(units: DataFrame) -> DataFrame:
    """(track, files, single)."""
    return units.groupBy("track").agg(F.count_distinct("file").alias("files")).withColumn("single", F.col("files") == 1)


def forbidden_keys(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(row columns, key) for each forbidden key at any depth of a JSON text; letters of
    a key may be escaped."""
    raw = F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(r'"((?:[^"\\]|\\.)+)"\s*:'), F.lit(1)))
    found = F.transform(raw, lambda k: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), k, F.lit('"]')), "array<string>"), F.lit(0)), k))
    return df.withColumn("key", F.explode(F.array_intersect(found, F.array(*[F.lit(k) for k in keys]))))


def key_paths(df: DataFrame, id: list[str], col: str, keys: list[str]) -> DataFrame:
    """A08 by structure: (id, key, path) for each forbidden key at any depth of a JSON text,
    with the path to it.  Texts are parsed once and opened level by level; only values that
    hold further keys go on, in a table a level, so the work ends with the deepest one.

    What stands in a string is no key.  Null texts have none.  A text that is no JSON, or names
    a key twice in one object, is searched by ``forbidden_keys`` and has a null path."""
    spark, names = df.sparkSession, [f"_id{i}" for i in range(len(id))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(id, names)], F.col(col).alias("_text"), F.try_parse_json(F.col(col)).alias("_v"))
    broken = forbidden_keys(rows.where("_v IS NULL AND _text IS NOT NULL").drop("_v"), "_text", keys)
    found = [broken.select(*names, "key", F.lit(None).cast("string").alias("path"))]
    level = rows.where("_v IS NOT NULL").select(*names, "_v", F.lit("$").alias("_path"))
    wanted, nested = F.col("key").isin(keys), F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<")
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        path = F.concat("_path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        step = written(opened.select(*names, "key", "value", path.alias("path"), nested.alias("_nested")).where(F.col("_nested") | wanted), "keys")
        found.append(step.where(wanted).select(*names, "key", "path"))
        level = step.where("_nested").select(*names, F.col("value").alias("_v"), F.col("path").alias("_path"))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select(*[F.col(n).alias(c) for c, n in zip(id, names)], "key", "path")


def summarize(units: DataFrame, by: list[str]) -> DataFrame:
    """Means of the six metrics and the number of records."""
    return units.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))


def method_means(units: DataFrame) -> DataFrame:
    """A10: by method the means of the metrics and, where records have them, of the rows and
    share of the memory and of the cost of a query; and the number of series."""
    extra = [c for c in ("memory_rows", "memory_ratio", "query_ms_per_patch") if c in units.columns]
    return units.groupBy("method").agg(*[F.avg(m).alias(m) for m in [*METRICS, *extra]], F.count_distinct("track", "dataset", "file").alias("series"))


def render(summary: DataFrame, by: list[str], aliases: dict[str, str]) -> DataFrame:
    """(by, a column of text for each alias, row): the metrics with three decimals under
    their aliases, and all of it as a line of a Markdown table."""
    cells = {alias: F.format_string("%.3f", F.col(m)) for alias, m in aliases.items()}
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(b) for b in by], *cells.values()), F.lit(" |"))
    return summary.select(*by, *[c.alias(alias) for alias, c in cells.items()], row.alias("row"))


def markdown(rows: DataFrame, by: str, headers: list[str]) -> DataFrame:
    """(by, body): the lines of a table in order below its head; one table has a line a
    method."""
    line = lambda cells: "| " + " | ".join(cells) + " |\n"
    head = F.lit(line(headers) + line(["---"] * len(headers)))
    return rows.groupBy(by).agg(F.concat(head, F.array_join(F.array_sort(F.collect_list("row")), "\n")).alias("body"))


def status(units: DataFrame, expected: int | None = None, seed: int = 2026) -> DataFrame:
    """A12."""
    s = units.agg(F.count(F.lit(1)).alias("records"), F.count_if(valid(seed)).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return s.withColumn("complete", F.col("valid") == (F.lit(expected) if expected is not None else F.col("records")))


def candidate_grid(grid: DataFrame, axes: dict[str, list], fixed: dict | None = None) -> DataFrame:
    """The product of rows (one axis, say, or none) with further axes and the fixed
    parameters; a plan, so small by nature."""
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid.select("*", *[F.lit(v).alias(k) for k, v in (fixed or {}).items()])


def sample_candidates(grid: DataFrame, n: int, seed: str, default: Column) -> DataFrame:
    """The default first, then by md5 of seed and configuration; ``trial`` from 0."""
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in grid.columns])
    ranked = grid.withColumn("_h", F.md5(F.concat(F.lit(seed), F.lit(":"), text).cast("binary"))).withColumn("_d", F.when(default, 0).otherwise(1))
    return ranked.orderBy("_d", "_h").limit(n).select((F.row_number().over(Window.orderBy("_d", "_h")) - 1).alias("trial"), *grid.columns)


def select_trial(trials: DataFrame, by: list[str]) -> DataFrame:
    """The best trial of each group: mean of the six means, then VUS-PR, VUS-ROC,
    range F1, the lowest trial."""
    means = trials.groupBy(*by, "trial").agg(*[F.avg(m).alias(m) for m in METRICS])
    means = means.withColumn("objective", F.round(sum((F.col(m) for m in METRICS), F.lit(0.0)) / len(METRICS), 9))
    w = Window.partitionBy(*by).orderBy(F.desc("objective"), F.desc(F.round("vus_pr", 9)), F.desc(F.round("vus_roc", 9)), F.desc(F.round("range_f1", 9)), "trial")
    return means.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def missing_trials(trials: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Expected (trial, file) combinations without a record."""
    return expected.join(trials, key, "left_anti")


def freeze(selection: DataFrame) -> DataFrame:
    """(fingerprint, n): sha256 over the sorted JSON rows; the selection has a row
    for each subset, so it is small.  The order of rows does not matter."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(selection.columns)]))
    return selection.select(row.alias("_j")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_j")), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def freeze_ranges(rows: DataFrame, key: list[str], parts: int = 256) -> DataFrame:
    """A17 for tables of any size: (part, n, fingerprint) of the rows whose key falls into each
    of ``parts`` parts.  Rows are hashed (sha256 of their JSON with sorted names) and the eight
    words of their hashes added up, so a part is a partial sum that any order and any number of
    tasks give alike, and no rows are gathered; a repeated row counts each time."""
    text = lambda cols: F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
    word = lambda h, i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")
    part = (word(F.sha2(text(key), 256), 0).cast("bigint") % parts).alias("part")
    sums = rows.select(part, F.sha2(text(rows.columns), 256).alias("_h")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(word(F.col("_h"), i)).alias(f"_w{i}") for i in range(8)])
    return sums.select("part", "n", F.sha2(F.concat_ws(",", "n", *[F.col(f"_w{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def freeze_root(ranges: DataFrame) -> DataFrame:
    """(fingerprint, n) of all parts, one row for each part being all it gathers."""
    listed = F.array_sort(F.collect_list(F.struct("part", "fingerprint")))
    return ranges.agg(F.sha2(F.array_join(F.transform(listed, lambda p: F.concat_ws(":", p["part"].cast("string"), p["fingerprint"])), "\n"), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def changed_ranges(new: DataFrame, old: DataFrame) -> DataFrame:
    """(part, n, n_old) of the parts that differ from a lock's; a side without the part
    counts 0 rows."""
    o = old.select("part", F.col("n").alias("n_old"), F.col("fingerprint").alias("_f"))
    j = new.join(o, "part", "full_outer").where(~F.col("fingerprint").eqNullSafe(F.col("_f")))
    return j.select("part", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n", "n_old")])


def check_lock(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new fingerprint, or a failure if a lock exists and differs, or several do."""
    other = old.select("fingerprint").distinct().agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("there are several locks")).cast("string")).otherwise(F.max("fingerprint")).alias("_old"))
    j = new.join(other, F.lit(True), "left")
    differs = F.col("_old").isNotNull() & (F.col("_old") != F.col("fingerprint"))
    return j.withColumn("fingerprint", F.when(differs, F.raise_error(F.lit("the lock has changed")).cast("string")).otherwise(F.col("fingerprint"))).drop("_old")


def macro_means(units: DataFrame) -> DataFrame:
    """Means at the grains all, track and (track, dataset), for each method."""
    per = units.groupingSets([["method"], ["method", "track"], ["method", "track", "dataset"]], "method", "track", "dataset")
    grain = F.when(F.grouping("track") == 1, "all").when(F.grouping("dataset") == 1, "track").otherwise("subset")
    return per.agg(grain.alias("grain"), *[F.avg(m).alias(m) for m in METRICS]).select("grain", "method", "track", "dataset", *METRICS)


def best_baseline(means: DataFrame, target: str) -> DataFrame:
    """(grain, track, dataset, metric, baseline, value, target_value, delta, win)."""
    long = means.unpivot(["grain", "track", "dataset", "method"], METRICS, "metric", "value")
    cell = ["grain", "track", "dataset", "metric"]
    base = long.where(F.col("method") != target).groupBy(*cell).agg(F.min(F.struct((-F.col("value")).alias("v"), "method")).alias("_b"))
    base = base.select(*cell, F.col("_b.method").alias("baseline"), (-F.col("_b.v")).alias("value"))
    mine = long.where(F.col("method") == target).select(*cell, F.col("value").alias("target_value"))
    on = reduce(lambda a, b: a & b, [base[c].eqNullSafe(mine[c]) for c in cell])
    return base.join(mine, on).select(*[base[c] for c in cell], "baseline", "value", "target_value", (F.col("target_value") - F.col("value")).alias("delta"), (F.col("target_value") > F.col("value")).alias("win"))


def gate(cells: DataFrame) -> DataFrame:
    """(grain, wins, cells, passed) for the global and track grains."""
    return cells.where(F.col("grain").isin("all", "track")).groupBy("grain").agg(F.count_if("win").alias("wins"), F.count(F.lit(1)).alias("cells"), F.bool_and("win").alias("passed"))


def continuation(report: DataFrame, locks: DataFrame, wins: tuple[int, int] = (6, 12), seed: int = 2026) -> DataFrame:
    """The report (seed, passed, global_wins, global_cells, track_wins, track_cells,
    fingerprint, ...) with ``may_continue``: it has the seed and passed, won all of the
    ``wins`` cells at either grain, and names a lock that is in force."""
    held = report.join(locks.select(F.col("fingerprint").alias("_f")).distinct(), F.col("fingerprint") == F.col("_f"), "left")
    ok = F.col("passed") & (F.col("seed") == seed) & F.col("_f").isNotNull()
    for grain, n in zip(("global", "track"), wins):
        ok = ok & (F.col(f"{grain}_wins") == n) & (F.col(f"{grain}_cells") == n)
    return held.withColumn("may_continue", F.coalesce(ok, F.lit(False))).drop("_f")


def phase_barrier(evaluation: DataFrame, tuning_audit: DataFrame) -> DataFrame:
    """Evaluation rows, none unless every tuning unit is valid (a one-row flag)."""
    flag = tuning_audit.agg((F.coalesce(F.sum(F.col("expected") - F.col("valid")), F.lit(1)) == 0).alias("_open"))
    return evaluation.join(F.broadcast(flag), F.lit(True)).where("_open").drop("_open")


def normalize_units(df: DataFrame) -> DataFrame:
    """Foreign shapes (method or methods[0], dataset or data, file or file_name)."""
    has = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n.split(".")[0] in has], F.lit(None).cast("string"))
    method = F.coalesce(*([F.col("method")] if "method" in has else []), *([F.get("methods", F.lit(0))] if "methods" in has else []), F.lit("unknown"))
    return df.select(method.alias("method"), F.upper(pick("track")).alias("track"), pick("dataset", "data").alias("dataset"), pick("file", "file_name").alias("file"), *[c for c in df.columns if c in ("seed", "error", *METRICS)])


def evidence(units: DataFrame, drop: tuple[str, ...] = ("runtime_s", "finished_at")) -> DataFrame:
    """Records without what differs between runs, in order of their keys."""
    return units.drop(*drop).orderBy(*KEY)


def effective_steps(requested: Column, rows: Column, batch: Column) -> Column:
    """min(requested, ceil(rows / batch)) if rows < 2 * batch, else as requested."""
    return F.when(rows < 2 * batch, F.least(requested, F.ceil(rows / batch))).otherwise(requested)


def validate_config(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(row columns, failed): the names of the checks that a row does not meet."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("failed", F.array_join(failed, ","))


def bind_config(files: DataFrame, lock: DataFrame) -> DataFrame:
    """Evaluation files with the frozen configuration of their (track, dataset)."""
    return files.join(lock, ["track", "dataset"])


def unbound(files: DataFrame, lock: DataFrame) -> DataFrame:
    """Files without a frozen configuration."""
    return files.join(lock, ["track", "dataset"], "left_anti")


def expected_units(methods: DataFrame, files: DataFrame) -> DataFrame:
    """Every method on every file.  Methods are a short list: their product with the
    files is the plan of work itself, made by exploding the list beside each file."""
    listed = methods.select("method").distinct().agg(F.array_sort(F.collect_list("method")).alias("_m"))
    return files.join(F.broadcast(listed), F.lit(True)).select(F.explode("_m").alias("method"), *files.columns)


def pending_units(expected: DataFrame, done: DataFrame, seed: int = 2026) -> DataFrame:
    """Expected units without a valid record."""
    return expected.join(valid_units(done, seed), KEY, "left_anti")


# ---- records and reports on disk ----


def scan_units(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON records of a directory tree; unreadable ones have only ``corrupt``."""
    schema = "method string, track string, dataset string, file string, seed int, split string, error string, metrics map<string,double>, hyperparameters string, runtime_s double, corrupt string"
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "corrupt").json(path)
    return raw.select("*", *[F.element_at("metrics", F.lit(m)).alias(m) for m in METRICS]).drop("metrics")


def write_reports(units: DataFrame, folder: str) -> None:
    """By series, by subset and by track, as CSV of full precision."""
    for name, df in (("series", units), ("subsets", summarize(units, ["track", "dataset", "method"])), ("tracks", summarize(units, ["track", "method"]))):
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def new_units(units: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose identity has not been published."""
    return units.join(existing, KEY, "left_anti")


def write_units(units: DataFrame, path: str) -> None:
    """Publish records once: identities already there are left as they are, and a
    different record under a published identity fails."""
    spark = units.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.parquet(path).select(*units.columns)
        changed = units.join(old, KEY, "left_semi").exceptAll(old.join(units, KEY, "left_semi"))
        if changed.head(1):
            raise ValueError("a published record differs")
        units = new_units(units, old)
    units.write.mode("append").partitionBy("track").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Point scores, a folder for each series; a series' rows meet first, so its folder
    has a file for each share of them and not for each task."""
    scores.hint("rebalance", "series_id").write.mode("overwrite").partitionBy("series_id").parquet(path)


def hash_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def audit_artifacts(spark: SparkSession, path: str, suffixes: list[str], names: list[str] = []) -> DataFrame:  # noqa: B006
    """Files with a forbidden suffix or name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    bad = reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes], name.isin(*names) if names else F.lit(False))
    return files.where(bad)
