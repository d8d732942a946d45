"""Evaluation gates on Spark: is a candidate better than a baseline, from a table of trials?"""
