"""tideline: a Spark-first engine for labelled time series."""
