"""Training-data operators: near-duplicates, quality, line and substring dedup,
tokenisation, token files, decontamination, toxicity and language ID.

Nothing outside this subpackage imports it. ``catalog.QUERIES`` holds the
registered queries, ``catalog.ORACLE`` their DuckDB SQL where SQL can say it.
"""
