"""terrafold: a Spark-first engine for exposure, access and allocation analytics.

Every operator is a function from DataFrames to DataFrames.  Nothing here
starts a session; callers bring their own, see :mod:`terrafold.session`.
"""
