"""Business analytics on Spark DataFrames: profile, score, clean, measure,
explain, forecast and project any table, each step a DataFrame-to-DataFrame
function that Spark plans and runs."""

__version__ = "0.1.0"
