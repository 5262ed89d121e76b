"""Functions of the forecasting engine."""
