"""sparkcohort: cohort analytics on Spark DataFrames."""
