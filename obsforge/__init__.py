"""obsforge: observability analytics (traces, logs, metrics, profiles) as lazy Spark DataFrames."""
