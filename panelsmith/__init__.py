"""Panel time-series analytics as Spark DataFrame operators.

Every operator is a function ``(DataFrame, ...) -> DataFrame`` that only builds
a plan.  The few that must run a job (adaptive calibration, the publish step)
say so in their docstring.
"""
