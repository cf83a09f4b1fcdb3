"""Panel forecasting and analysis on Spark DataFrames."""
