"""winnow: explainable text triage on Spark DataFrames."""
