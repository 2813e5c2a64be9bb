"""Operators: every one takes DataFrames and returns a DataFrame.

Work on one page stays in that page's row (no shuffle, the HTML never moves); work across pages or
over the long field table is expressed as mergeable aggregates, so no group is ever held in one task.
"""
