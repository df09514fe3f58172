"""Vital signs of all patients: parsing, merging by date, range checks, summaries and reports.

Rows are ``patient, metric, date, valeur`` with text values; blood pressure is ``"sys/dia"``.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.text import constant, strip_accents
from docflow.functions.wordlists import VITAL_RANGES

PRESSURE = "tension"


def vitals_union(tables: dict[str, DataFrame], patient: str | None = None) -> DataFrame:
    """One long table from a table per metric. A patient filter ignores case and is pushed to the sources."""
    def one(metric: str, df: DataFrame) -> DataFrame:
        rows = df if patient is None else df.where(F.lower("nom") == patient.lower())
        return rows.select(F.col("nom").alias("patient"), F.lit(metric).alias("metric"), "date", "valeur")

    return reduce(DataFrame.unionByName, [one(m, df) for m, df in tables.items()])


def vitals_from_catalog(spark: SparkSession, database: str, patient: str | None = None) -> DataFrame:
    """Every table of a catalog database that has the vitals columns; others are skipped."""
    found = {}
    for t in spark.catalog.listTables(database):
        df = spark.table(f"`{database}`.`{t.name}`")
        if {"nom", "date", "valeur"} <= set(df.columns):
            found[t.name] = df
    if not found:
        raise ValueError(f"no vitals tables in database {database!r}")
    return vitals_union(found, patient)


def parse_dates(vitals: DataFrame) -> DataFrame:
    """Date column typed; rows without a valid date are dropped."""
    day = F.coalesce(F.col("date").try_cast("date"), F.try_to_timestamp("date").cast("date"))
    return vitals.withColumn("date", day).where(F.col("date").isNotNull())


def split_pressure(vitals: DataFrame) -> DataFrame:
    """``patient, date, tension_sys, tension_dia``; values without exactly one slash are dropped."""
    parts = F.split("valeur", "/")
    rows = vitals.where((F.lower("metric") == PRESSURE) & (F.size(parts) == 2))
    return rows.select(
        "patient", "date",
        F.get(parts, F.lit(0)).try_cast("double").alias("tension_sys"),
        F.get(parts, F.lit(1)).try_cast("double").alias("tension_dia"),
    )


def numeric(vitals: DataFrame) -> DataFrame:
    """Other metrics as numbers; text that is no number becomes null."""
    return vitals.where(F.lower("metric") != PRESSURE).select(
        "patient", "metric", "date", F.col("valeur").try_cast("double").alias("value")
    )


def long_values(vitals: DataFrame) -> DataFrame:
    """``patient, date, metric, value`` with pressure as two metrics; one pass over the rows."""
    parts = F.split("valeur", "/")
    pressure = F.lower("metric") == PRESSURE

    def pair(name: Column | str, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), value.try_cast("double").alias("value"))

    values = F.when(
        pressure, F.array(pair("tension_sys", F.get(parts, F.lit(0))), pair("tension_dia", F.get(parts, F.lit(1))))
    ).otherwise(F.array(pair(F.col("metric"), F.col("valeur"))))
    return vitals.where(~pressure | (F.size(parts) == 2)).select("patient", "date", F.inline(values))


def merge_by_date(vitals: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide table by chained full outer joins on patient and date; repeated dates multiply rows."""
    numbers = numeric(vitals)

    def frame(metric: str) -> DataFrame:
        if metric == PRESSURE:
            return split_pressure(vitals)
        return numbers.where(F.col("metric") == metric).select("patient", "date", F.col("value").alias(metric))

    return reduce(lambda a, b: a.join(b, ["patient", "date"], "full"), [frame(m) for m in metrics])


def merge_daily(values: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide table with the daily mean of each metric: one shuffle, one row per patient and date."""
    return values.groupBy("patient", "date").pivot("metric", metrics).agg(F.avg("value"))


def _plain(c: Column) -> Column:
    return strip_accents(F.lower(c))


def with_flags(values: DataFrame, ranges: dict[str, tuple[float, float]] = VITAL_RANGES,
               null_is_abnormal: bool = False, exact_names: bool = False) -> DataFrame:
    """Add ``abnormal`` to long rows whose metric has a range; other metrics get null.

    A missing value is not assessed unless ``null_is_abnormal``. Metric names are matched without
    accents unless ``exact_names``.
    """
    key = F.col("metric") if exact_names else _plain(F.col("metric"))
    plain = ranges if exact_names else {_ascii(m): r for m, r in ranges.items()}
    low, high = constant({m: float(r[0]) for m, r in plain.items()})[key], constant({m: float(r[1]) for m, r in plain.items()})[key]
    inside = F.col("value").between(low, high)
    flag = F.coalesce(~inside, F.lit(True)) if null_is_abnormal else ~inside
    return values.withColumn("abnormal", F.when(low.isNotNull(), flag))


def _ascii(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(c))


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("patient", "metric").agg(F.count_if("abnormal").alias("n_abnormal"))


def anomaly_summary(flagged: DataFrame, ranges: dict[str, tuple[float, float]] = VITAL_RANGES) -> DataFrame:
    """``patient, summary``: one line per metric with abnormal values in range order, or the all-clear."""
    order = {_ascii(m): n for n, m in enumerate(ranges)}
    bad = anomaly_counts(flagged).where(F.col("n_abnormal") > 0)
    line = F.concat(
        F.lit("🔴 "), "metric", F.lit(" : "), F.col("n_abnormal").cast("string"), F.lit(" valeur(s) anormale(s) détectée(s)")
    )
    place = constant(order)[_plain(F.col("metric"))]
    # one line per metric of a patient
    lines = bad.groupBy("patient").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), line.alias("l")))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["l"]), "\n")
    everyone = flagged.select("patient").distinct()
    return everyone.join(lines, "patient", "left").select(
        "patient", F.coalesce(text, F.lit("✅ Aucune anomalie détectée sur les constantes.")).alias("summary")
    )


def series(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Chart input: ``patient, date, metric, value`` from the wide table, points only where there is a value."""
    return wide.unpivot(["patient", "date"], metrics, "metric", "value").where(F.col("value").isNotNull())


def report(patients: DataFrame, vitals: DataFrame) -> DataFrame:
    """One row per requested patient: message, number of values and dates, anomaly summary."""
    values = long_values(parse_dates(vitals))
    sizes = values.groupBy("patient").agg(F.count("value").alias("n_values"), F.countDistinct("date").alias("n_dates"))
    done = sizes.join(anomaly_summary(with_flags(values)), "patient")
    name = F.col("patient").cast("string")
    found = F.concat(
        F.lit("Voici les constantes de santé disponibles pour "), name, F.lit(", accompagnées de leur visualisation et analyse.")
    )
    none = F.concat(F.lit("ℹ️ Aucune donnée de constantes trouvée pour le patient "), name, F.lit("."))
    return patients.select("patient").join(done, "patient", "left").select(
        "patient",
        F.when(F.col("n_values").isNull(), none).otherwise(found).alias("message"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_dates", F.lit(0)).alias("n_dates"),
        F.coalesce("summary", F.lit("Aucune anomalie détectée car aucune constante n’est disponible.")).alias("summary"),
    )
