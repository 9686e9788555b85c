"""Training-data operators: archives, tokens, rules, deduplication, scoring and mixing.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
