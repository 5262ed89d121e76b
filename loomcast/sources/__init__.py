"""Sources of the forecasting engine."""
