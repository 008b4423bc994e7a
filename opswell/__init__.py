"""Operational analytics on Spark DataFrames: tables, lifecycle events, counters, logs, inventories, alerts."""
