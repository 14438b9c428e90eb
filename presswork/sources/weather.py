"""Current weather of cities through an injected fetcher, with a table of the hour's answers in front of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.visibility import ts
from presswork.sources.feeds import fetched

def _number(json: Column, path: str) -> Column:
    return F.get_json_object(json, path).try_cast("double")


def parsed(place: Column, forecast: Column) -> list[Column]:
    """What a place's answer and a forecast's answer say; null where they are no objects or lack a field."""
    code = _number(forecast, "$.current.weather_code").cast("int")
    return [
        F.coalesce(F.get_json_object(place, "$.results[0].name"), F.col("city")).alias("resolved"),
        _number(forecast, "$.current.temperature_2m").alias("now"),
        _number(forecast, "$.daily.temperature_2m_min[0]").alias("low"),
        _number(forecast, "$.daily.temperature_2m_max[0]").alias("high"),
        _number(forecast, "$.daily.precipitation_probability_max[0]").alias("rain"),
        _number(forecast, "$.current.wind_speed_10m").alias("wind"),
        code.alias("code"),
    ]


def forecasts(cities: DataFrame, fetch: Callable[[str], bytes | None], places: str, forecast: str, now: str, cache: str | None = None, zone: str = "Asia/Shanghai") -> DataFrame:
    """(city, resolved, now, low, high, rain, wind, code) of the distinct named cities; a city that can't be had has nulls.

    ``places`` and ``forecast`` are the addresses of the two services. With ``cache``, a folder of Parquet files, the hour's
    answers are read from there and only missing cities are asked for; answers that failed are asked for again.
    """
    hour = F.date_format(ts(now), "yyyy-MM-dd-HH")
    names = cities.select(F.btrim("city").alias("city")).filter("city <> ''").distinct()
    known = None
    if cache:
        try:
            known = cities.sparkSession.read.parquet(cache).filter(F.col("hour") == hour).drop("hour").dropDuplicates(["city"])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    asked = names.join(known.select("city"), "city", "left_anti") if known is not None else names
    found = fetched(asked.withColumn("url", F.concat(F.lit(places + "?count=1&format=json&name="), F.url_encode("city"))), fetch).withColumn("place", F.col("body").cast("string")).drop("body", "tries", "error", "url")
    at = {k: _number(F.col("place"), f"$.results[0].{k}") for k in ("latitude", "longitude")}
    query = F.concat(
        F.lit(forecast + "?current=temperature_2m,weather_code,wind_speed_10m,precipitation&daily=temperature_2m_max,temperature_2m_min,precipitation_probability_max,weather_code"),
        F.lit(f"&timezone={zone}&forecast_days=1&latitude="), at["latitude"].cast("string"), F.lit("&longitude="), at["longitude"].cast("string"),
    )
    located = found.withColumn("url", query)
    told = fetched(located.filter("url is not null"), fetch).select("city", "place", F.col("body").cast("string").alias("answer"))
    whole = told.unionByName(located.filter("url is null").select("city", "place", F.lit(None).cast("string").alias("answer")))
    rows = whole.select("city", *parsed(F.col("place"), F.col("answer")))
    if not cache:
        return rows
    rows.filter("now is not null").withColumn("hour", hour).write.mode("append").parquet(cache)
    kept = cities.sparkSession.read.parquet(cache).filter(F.col("hour") == hour).drop("hour").dropDuplicates(["city"])
    return names.join(kept, "city", "left")
