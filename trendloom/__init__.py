"""PySpark analytics over retail snapshots: labels, matching, evaluation, forecasts and query tools."""
