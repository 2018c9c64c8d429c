"""A dataflow analytics engine on PySpark.

A program is a small graph of named operators whose parameters are written in a compact
expression language; each graph becomes one Spark DataFrame plan.
"""
