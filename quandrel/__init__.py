"""Quantile forecasts of many series, their calibration and scoring, as Spark DataFrame jobs."""
