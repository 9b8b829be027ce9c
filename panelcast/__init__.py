"""Spark jobs for panel density forecasting: DataFrame in, DataFrame out, no session is made here."""
