"""millrace: telemetry normalisation and training-data preparation on Spark DataFrames."""
