"""Audit and change planning for multi-tenant access-control configuration, on Spark.

Every function takes and returns DataFrames.  The products are findings, change
plans, a run ledger and summary counters; no server is ever contacted.
"""
