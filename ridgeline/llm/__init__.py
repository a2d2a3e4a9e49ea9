"""Training-data operators: search, filtering, de-duplication, sampling, packing.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; ``queries.py`` binds them to the tables of a data folder.
"""
