"""Plans of the forecasting engine."""
