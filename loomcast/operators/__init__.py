"""Operators of the forecasting engine."""
