"""Vital signs derived from the whole events table: type to metric, user to patient."""

from pyspark.sql import functions as F

from docflow.operators import render
from docflow.operators import vitals as vt
from docflow.registry.base import query, table

METRICS = ["poids", "frequence_cardiaque", "temperature", "tension"]
WIDE = ["poids", "frequence_cardiaque", "temperature", "tension_sys", "tension_dia"]


def raw_vitals(events):
    """``error`` rows are pressures, ``signup`` rows malformed pressures; some dates are damaged."""
    def dec(shift):
        return (F.col("value") + shift).cast("decimal(10,2)").cast("string")

    kind = F.col("event_type")
    metric = (
        F.when(kind == "view", "poids").when(kind == "click", "frequence_cardiaque").when(kind == "purchase", "temperature").otherwise("tension")
    )
    low = (F.col("event_id") % 50 + 50).cast("string")
    value = (
        F.when(kind == "view", dec(40)).when(kind == "click", F.when(F.col("value") < 5, "n/a").otherwise(dec(60)))
        .when(kind == "purchase", dec(34)).when(kind == "error", F.concat(dec(80), F.lit("/"), low))
        .otherwise(F.concat(dec(80), F.lit("/"), low, F.lit("/1")))
    )
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.when(k == 7, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return events.select(F.col("user_id").alias("patient"), metric.alias("metric"), day.alias("date"), value.alias("valeur"))


def vitals(spark, sf):
    return raw_vitals(table(spark, sf, "events"))


_D = "(value + {0})::DECIMAL(10,2)::VARCHAR"
RAW_SQL = f"""SELECT user_id AS patient, CASE event_type WHEN 'view' THEN 'poids' WHEN 'click' THEN 'frequence_cardiaque' WHEN 'purchase' THEN 'temperature' ELSE 'tension' END AS metric,
  CASE WHEN (props->>'k')::INT = 7 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE event_type WHEN 'view' THEN {_D.format(40)} WHEN 'click' THEN CASE WHEN value < 5 THEN 'n/a' ELSE {_D.format(60)} END WHEN 'purchase' THEN {_D.format(34)}
   WHEN 'error' THEN {_D.format(80)} || '/' || (event_id % 50 + 50) ELSE {_D.format(80)} || '/' || (event_id % 50 + 50) || '/1' END AS valeur FROM events"""
DATED_SQL = f"SELECT patient, metric, date, valeur FROM ({RAW_SQL}) WHERE try_cast(date AS DATE) IS NOT NULL"
BP_SQL = f"SELECT patient, date, try_cast(split_part(valeur, '/', 1) AS DOUBLE) AS tension_sys, try_cast(split_part(valeur, '/', 2) AS DOUBLE) AS tension_dia FROM ({DATED_SQL}) WHERE metric = 'tension' AND len(string_split(valeur, '/')) = 2"
NUM_SQL = f"SELECT patient, metric, date, try_cast(valeur AS DOUBLE) AS value FROM ({DATED_SQL}) WHERE metric <> 'tension'"
LONG_SQL = f"SELECT patient, date, metric, value FROM ({NUM_SQL}) UNION ALL SELECT patient, date, 'tension_sys', tension_sys FROM ({BP_SQL}) UNION ALL SELECT patient, date, 'tension_dia', tension_dia FROM ({BP_SQL})"


def _text_date(df):
    return df.withColumn("date", F.col("date").cast("string"))


@query("src_vitals_union", RAW_SQL)
def src_vitals_union(spark, sf):
    raw = vitals(spark, sf)
    tables = {m: raw.where(F.col("metric") == m).withColumnRenamed("patient", "nom") for m in METRICS}
    return vt.vitals_union(tables)


@query("vitals_parse_date", DATED_SQL)
def vitals_parse_date(spark, sf):
    return _text_date(vt.parse_dates(vitals(spark, sf)))


@query("vitals_split_bp", BP_SQL)
def vitals_split_bp(spark, sf):
    return _text_date(vt.split_pressure(vt.parse_dates(vitals(spark, sf))))


@query("vitals_numeric", NUM_SQL)
def vitals_numeric(spark, sf):
    return _text_date(vt.numeric(vt.parse_dates(vitals(spark, sf))))


def _s_metric(m):
    return f"(SELECT patient, date, value AS {m} FROM ({NUM_SQL}) WHERE metric = '{m}')"


@query(
    "vitals_merge",
    f"SELECT patient, date, poids, frequence_cardiaque, temperature, tension_sys, tension_dia FROM {_s_metric('poids')} FULL JOIN {_s_metric('frequence_cardiaque')} USING (patient, date) FULL JOIN {_s_metric('temperature')} USING (patient, date) FULL JOIN ({BP_SQL}) USING (patient, date)",
)
def vitals_merge(spark, sf):
    return _text_date(vt.merge_by_date(vt.parse_dates(vitals(spark, sf)), METRICS))


DAILY_SQL = "SELECT patient, date, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 6) AS {m}" for m in WIDE) + f" FROM ({LONG_SQL}) GROUP BY patient, date"


def daily(spark, sf):
    wide = vt.merge_daily(vt.long_values(vt.parse_dates(vitals(spark, sf))), WIDE)
    return wide.select("patient", "date", *[F.round(m, 6).alias(m) for m in WIDE])


@query("vitals_merge_daily", DAILY_SQL)
def vitals_merge_daily(spark, sf):
    return _text_date(daily(spark, sf))


def _s_flags(nulls, exact=False):
    temp = "'température'" if exact else "'temperature'"
    inside = f"CASE metric WHEN 'poids' THEN value BETWEEN 45 AND 100 WHEN {temp} THEN value BETWEEN 36 AND 38 WHEN 'tension_sys' THEN value BETWEEN 90 AND 140 WHEN 'tension_dia' THEN value BETWEEN 60 AND 90 END"
    known = f"metric IN ('poids', {temp}, 'tension_sys', 'tension_dia')"
    flag = f"NOT coalesce({inside}, FALSE)" if nulls else f"NOT ({inside})"
    return f"SELECT *, CASE WHEN {known} THEN {flag} END AS abnormal FROM ({LONG_SQL})"


def values(spark, sf):
    return vt.long_values(vt.parse_dates(vitals(spark, sf)))


def _s_told(sql):
    return f"SELECT patient, date, metric, value, CASE WHEN abnormal THEN 'yes' WHEN NOT abnormal THEN 'no' ELSE 'unknown' END AS abnormal FROM ({sql})"


def told(df):
    flag = F.when(F.col("abnormal"), "yes").when(~F.col("abnormal"), "no").otherwise("unknown")
    return _text_date(df).withColumn("abnormal", flag)


@query("vitals_flags", _s_told(_s_flags(False)))
def vitals_flags(spark, sf):
    return told(vt.with_flags(values(spark, sf)))


@query("vitals_flags_compat", _s_told(_s_flags(True, True)))
def vitals_flags_compat(spark, sf):
    return told(vt.with_flags(values(spark, sf), null_is_abnormal=True, exact_names=True))


SUMMARY_SQL = f"""SELECT p.patient, coalesce(string_agg('🔴 ' || metric || ' : ' || n || ' valeur(s) anormale(s) détectée(s)', chr(10) ORDER BY list_position(['poids', 'temperature', 'tension_sys', 'tension_dia'], metric)) FILTER (n > 0), '✅ Aucune anomalie détectée sur les constantes.') AS summary
  FROM (SELECT DISTINCT patient FROM ({LONG_SQL})) p LEFT JOIN (SELECT patient, metric, count(*) FILTER (abnormal) AS n FROM ({_s_flags(False)}) GROUP BY ALL) c ON c.patient = p.patient GROUP BY p.patient"""


@query("vitals_anomaly_summary", SUMMARY_SQL)
def vitals_anomaly_summary(spark, sf):
    return vt.anomaly_summary(vt.with_flags(values(spark, sf)))


@query("vitals_series", f"UNPIVOT ({DAILY_SQL}) ON {', '.join(WIDE)} INTO NAME metric VALUE value")
def vitals_series(spark, sf):
    return _text_date(vt.series(daily(spark, sf), WIDE))


@query(
    "vitals_report",
    f"""SELECT c_custkey AS patient, CASE WHEN n IS NULL THEN 'ℹ️ Aucune donnée de constantes trouvée pour le patient ' || c_custkey || '.' ELSE 'Voici les constantes de santé disponibles pour ' || c_custkey || ', accompagnées de leur visualisation et analyse.' END AS message,
       coalesce(n, 0) AS n_values, coalesce(d, 0) AS n_dates, coalesce(summary, 'Aucune anomalie détectée car aucune constante n’est disponible.') AS summary FROM customer
       LEFT JOIN (SELECT patient, count(value) AS n, count(DISTINCT date) AS d FROM ({LONG_SQL}) GROUP BY patient) v ON v.patient = c_custkey LEFT JOIN ({SUMMARY_SQL}) s ON s.patient = c_custkey""",
)
def vitals_report(spark, sf):
    patients = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"))
    return vt.report(patients, vitals(spark, sf))


@query(
    "markdown_table",
    f"""SELECT patient, month, '| date | poids | tension_sys |' || chr(10) || '|:---|:---|:---|' || chr(10) || string_agg('| ' || date || ' | ' || coalesce(poids::VARCHAR, '') || ' | ' || coalesce(tension_sys::VARCHAR, '') || ' |', chr(10) ORDER BY date) AS "table"
       FROM (SELECT *, date[:7] AS month FROM ({DAILY_SQL})) GROUP BY patient, month""",
)
def markdown_table(spark, sf):
    wide = daily(spark, sf).withColumn("month", F.date_format("date", "yyyy-MM"))
    return render.markdown_table(wide, ["patient", "month"], ["date"], ["date", "poids", "tension_sys"])
