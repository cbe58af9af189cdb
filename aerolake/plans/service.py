"""The query surface: one function per question a client asks.

All questions take ``as_of`` instead of the clock, and answer for every city
at once unless cities are given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import cities, compare, evaluate, forecast, quality, stations
from aerolake.operators.sets import latest_row


@dataclass
class AirQuality:
    """History, live rows and dimensions the answers are computed from.

    ``history``: daily readings (city, station, date, aqi, identifiers);
    ``live``: (city, ts, aqi, ...); ``stations``: station dimension;
    ``aliases``: (alias, canonical); ``model_predictions``: (city, date, model, model_aqi).
    """

    history: DataFrame
    live: DataFrame
    stations: DataFrame
    aliases: DataFrame
    model_predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    models: tuple[str, ...] = ()
    default_model: str = "simple"

    def city_list(self) -> DataFrame:
        return cities.canonical_cities(self.aliases).orderBy("city")

    def _requested(self, names: list[str] | None) -> DataFrame:
        if names is None:
            return cities.canonical_cities(self.aliases)
        spark = self.history.sparkSession
        asked = spark.createDataFrame([(n,) for n in names], "city string")
        return cities.normalize_city(asked, self.aliases, policy="error", keep_original=False).distinct()

    def current(self) -> DataFrame:
        newest = latest_row(self.live, ["city"], ["ts", "aqi"])
        return newest.withColumnRenamed("aqi", "current_aqi")

    def _forecast(self, as_of: str, days: int, names: list[str] | None = None) -> DataFrame:
        return forecast.predict_simple(forecast.forecast_spine(self._requested(names), as_of, days), self.history)

    def current_aqi(self, as_of: str) -> DataFrame:
        return compare.status_with_forecast(self.current(), self._forecast(as_of, 2), as_of)

    def predict(self, requests: DataFrame, as_of: str) -> DataFrame:
        """``requests``: (city, date, model_type); requests for ``as_of`` are compared with the live row of their city."""
        named = cities.normalize_city(requests, self.aliases, policy="error").withColumnRenamed("city_original", "city_requested")
        none = named.sparkSession.createDataFrame([], "city string, date date, model string, model_aqi double")
        answers = forecast.predict_with_fallback(
            named, self.history, self.model_predictions if self.model_predictions is not None else none,
            list(self.models), self.default_model,
        )
        return compare.with_live_comparison(answers, self.current(), as_of)

    def future(self, names: list[str], as_of: str, days: int = 7, scored: DataFrame | None = None) -> DataFrame:
        return self.predict_stations(names, as_of, days, scored)

    def predict_stations(self, names: list[str] | None, as_of: str, days: int = 1, scored: DataFrame | None = None) -> DataFrame:
        """Station rows and city rows; ``scored``: (station_id, date, model, model_aqi) of a trained model."""
        usable = stations.valid_stations(self.stations)
        return forecast.predict_stations(self._requested(names), usable, self.history, self.history, as_of, days, scored=scored)

    def station_summary(self, names: list[str] | None, as_of: str) -> DataFrame:
        return compare.prediction_summary(self.predict_stations(names, as_of))

    def city_comparison(self, as_of: str) -> DataFrame:
        return compare.city_comparison(self.current(), self._forecast(as_of, 2), as_of)

    def realtime(self, as_of: str) -> DataFrame:
        return compare.realtime_vs_forecast(self.current(), self._forecast(as_of, 8), as_of)

    def city_stations(self, names: list[str] | None = None) -> DataFrame:
        usable = stations.valid_stations(self.stations)
        return usable if names is None else usable.join(self._requested(names), "city", "left_semi")

    def model_performance(self) -> DataFrame:
        empty = self.history.sparkSession.createDataFrame([], "model string, metric string, value double")
        return evaluate.merge_performance_defaults(self.metrics if self.metrics is not None else empty)

    def available_models(self) -> DataFrame:
        return evaluate.model_registry(self.model_performance())

    def status(self) -> DataFrame:
        return quality.system_counts(self.history, self.live)

    def city_profile(self) -> DataFrame:
        return quality.city_profile(self.history.select("city", "station", "date", F.col("aqi")))
