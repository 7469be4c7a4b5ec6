"""Benchmarks: parameter grids, repeated runs, and tables of what they gave."""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Results that are no numbers, and how tables show them.
FAILED, TIMEOUT, UNPARSED = -1.0, -2.0, -3.0
CODES = {FAILED: "W", TIMEOUT: "T", UNPARSED: "U"}

# Two-sided 95 % quantiles of Student's t for 1 to 31 degrees of freedom (fixed values), and of the normal distribution.
_T = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120,
    2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042, 2.040,
)
_NORMAL = 1.960


def grid(parameters: dict[str, list], apps: list[str], only: set[str] | None = None, exclude: set[str] | None = None) -> list[dict]:
    """Every combination of the parameters' values with every app that is asked for and not excluded."""
    chosen = [a for a in apps if (only is None or a in only) and a not in (exclude or set())]
    names = list(parameters)
    return [{"app": a, **dict(zip(names, values))} for a in chosen for values in itertools.product(*parameters.values())]


def run(spark: SparkSession, experiments: list[dict], action: Callable[[dict], float], times: int = 1, dry: bool = False) -> DataFrame:
    """app, config, repetition, value: action returns a value, or raises (failed), or raises TimeoutError."""
    rows = []
    for e in experiments:
        config = ",".join(f"{k}={v}" for k, v in e.items() if k != "app")
        for k in range(times):
            try:
                value = 0.0 if dry else float(action(e))
            except TimeoutError:
                value = TIMEOUT
            except Exception:
                value = FAILED
            rows.append((e["app"], config, k, value))
    return spark.createDataFrame(rows, "app string, config string, repetition int, value double")


def throughput(df: DataFrame, n_bytes: int) -> float:
    """MB (10^6 bytes) a second of running df to its end, its rows thrown away."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return n_bytes / (time.perf_counter() - began) / 1e6


def read_log(lines: DataFrame, keyword: str) -> DataFrame:
    """path, value of log lines (path, pos, value): the number behind '=' or ':' in the first line with the keyword."""
    found = lines.where(F.contains("value", F.lit(keyword))).groupBy("path").agg(F.min_by("value", "pos").alias("line"))
    number = F.expr(r"try_cast(trim(regexp_extract(line, '[=:]\\s*([^\\s=:]+)\\s*$', 1)) AS double)")
    paths = lines.select("path").distinct()
    timed = lines.groupBy("path").agg(F.bool_or(F.contains(F.lower("value"), F.lit("timeout"))).alias("timed"))
    out = paths.join(found, "path", "left").join(timed, "path")
    value = F.when(F.col("line").isNull(), F.when(F.col("timed"), TIMEOUT).otherwise(FAILED)).otherwise(F.coalesce(number, F.lit(UNPARSED)))
    return out.select("path", value.alias("value"))


def statistics(results: DataFrame) -> DataFrame:
    """app, config, n, mean, std and ci95 (half width) of the repetitions that gave a number; a code where none did."""
    good = F.when(F.col("value") >= 0, F.col("value"))
    out = results.groupBy("app", "config").agg(
        F.count(good).alias("n"), F.avg(good).alias("mean"), F.stddev_samp(good).alias("sd"), F.stddev_pop(good).alias("std"), F.max("value").alias("code")
    )
    t = F.when(F.col("n") <= 32, F.element_at(F.array(*map(F.lit, _T)), F.greatest(F.col("n") - 1, F.lit(1)).cast("int"))).otherwise(_NORMAL)
    return out.select(
        "app", "config", "n", F.coalesce("mean", "code").alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"),
        F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n")).otherwise(0.0).alias("ci95"),
    )


def normalised(stats: DataFrame, baseline: str) -> DataFrame:
    """stats with ratio, the mean over the baseline configuration's of the same app; null where either is no number."""
    base = stats.where((F.col("config") == baseline) & (F.col("mean") > 0)).select("app", F.col("mean").alias("base"))
    return stats.join(base, "app", "left").withColumn("ratio", F.when(F.col("mean") > 0, F.col("mean") / F.col("base"))).drop("base")


def geometric_means(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("config").agg(F.exp(F.avg(F.log("ratio"))).alias("geomean"))


def best_variant(stats: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """app, variant, mean: of each named group of configurations the best one of every app."""
    rows = [(c, g) for g, configs in groups.items() for c in configs]
    of = stats.sparkSession.createDataFrame(rows, "config string, variant string")
    return stats.join(F.broadcast(of), "config").groupBy("app", "variant").agg(F.max("mean").alias("mean"))


def table(stats: DataFrame, apps: dict[str, str] | None = None, configs: dict[str, str] | None = None, digits: int = 1) -> DataFrame:
    """A row per app and a column per configuration, by their display names and in the dictionaries' order; codes as letters."""
    shown = F.format_number("mean", digits)
    shown = F.replace(shown, F.lit(","), F.lit(""))
    for code, letter in CODES.items():
        shown = F.when(F.col("mean") == code, letter).otherwise(shown)
    spark = stats.sparkSession
    rows = stats.withColumn("shown", shown)
    if configs:
        names = spark.createDataFrame(list(configs.items()), "config string, config_name string")
        rows = rows.join(F.broadcast(names), "config").withColumn("config", F.col("config_name"))
    if apps:
        names = spark.createDataFrame([(a, n, k) for k, (a, n) in enumerate(apps.items())], "app string, app_name string, place int")
        rows = rows.join(F.broadcast(names), "app").withColumn("app", F.col("app_name"))
    else:
        rows = rows.withColumn("place", F.lit(0))
    wide = rows.groupBy("place", "app").pivot("config", list(configs.values()) if configs else None).agg(F.first("shown"))
    return wide.orderBy("place", "app").drop("place")


def tune(spark: SparkSession, make: Callable[..., DataFrame], n_bytes: int, valid: Callable[[DataFrame], bool], **parameters: list) -> tuple[dict, DataFrame]:
    """The fastest valid combination of parameters, and all measurements."""
    best, rows = None, []
    for values in itertools.product(*parameters.values()):
        chosen = dict(zip(parameters, values))
        df = make(**chosen)
        value = throughput(df, n_bytes) if valid(df) else FAILED
        rows.append((str(chosen), value))
        if value > 0 and (best is None or value > best[1]):
            best = chosen, value
    return (best[0] if best else {}), spark.createDataFrame(rows, "config string, value double")


def parse_flags(text: str) -> dict[str, str]:
    """'--a=1 --b' as a dict; flags without a value are 'true'."""
    return {k: v or "true" for k, v in re.findall(r"--([\w-]+)(?:[= ]([^\s-][^\s]*))?", text)}
