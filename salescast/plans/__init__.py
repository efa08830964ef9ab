"""The steps put together: training, scoring, evaluation."""

from salescast.plans.forecaster import Forecaster, Roles, fit_forecaster

__all__ = ["Forecaster", "Roles", "fit_forecaster"]
