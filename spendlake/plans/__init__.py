"""Whole jobs: build marts, explore a fact, run the forecasts."""
