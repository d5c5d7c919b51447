"""The forecast job: features, ensemble, state and segment forecasts, portfolio figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..models import forecast as fc
from ..operators import events as ev
from ..operators import growth
from ..session import settle


def run(panel: DataFrame, reference: DataFrame, events: DataFrame, uplift: DataFrame, cutoff: int,
        months: list[int], learners: dict[str, object] | None = None,
        folds: int = 5) -> tuple[DataFrame, fc.Ensemble]:
    """State forecasts of the months after the cutoff, and the ensemble behind them.

    The events become a row per state and month once; the features, their scaling and the forecast read that.
    """
    history = panel.filter(F.col("year_month") <= cutoff)
    event_months = settle(ev.event_panel(events, uplift))
    features = ev.feature_rows(history, reference, event_months)
    ensemble = fc.fit_ensemble(features, learners or fc.state_learners(), folds)
    return fc.forecast_states(panel, reference, event_months, ensemble, cutoff, months), ensemble


def portfolio(panel: DataFrame, forecast: DataFrame, events: DataFrame, year: int,
              now: tuple[int, int], before: tuple[int, int]) -> DataFrame:
    """One row: year total, forecast of the period, lift %, busiest state, fastest state."""
    series = growth.actual_or_forecast(panel.filter(F.col("year_month") < now[0]), forecast, ["state"])
    whole_year = panel.filter(F.col("year_month").between(year * 100 + 1, year * 100 + 12))
    total = whole_year.select(F.sum("spend").cast("double")).scalar()
    by_state = growth.period_growth(series, ["state"], now, before)
    fastest = by_state.select(F.max_by("state", F.struct("growth_pct", "state"))).scalar()
    scores = (ev.event_scores(events).filter(F.col("year_month").between(*now)).groupBy("state")
              .agg(F.sum("event_score").alias("score")))
    busiest = scores.select(F.max_by("state", F.struct("score", "state"))).scalar()
    flat = growth.period_growth(series, [], now, before)
    return flat.select(
        total.alias("total_spend"), F.col("now_spend").cast("double").alias("forecast_spend"),
        F.col("growth_pct").alias("lift_pct"), busiest.alias("top_event_state"),
        fastest.alias("top_growth_state"))
