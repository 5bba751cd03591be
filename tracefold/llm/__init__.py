"""Operators of the training-data pipeline; nothing outside this folder imports them."""
