"""Daily climate analytics for weather-station records, expressed as Spark DataFrames."""

from klimawerk.plans.engine import ClimateEngine

__all__ = ["ClimateEngine"]
