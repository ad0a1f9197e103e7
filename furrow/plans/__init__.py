"""Jobs composed from operators: forecasts, back-tests, learning, alerts."""
