"""Scoring-likelihood analytics as Spark jobs.

``sources`` reads and writes tables, ``functions`` holds Column expressions,
``operators`` holds DataFrame-to-DataFrame steps and ``plans`` strings them
together: the feature table, the backtest and the scoring of a coming week.
"""
