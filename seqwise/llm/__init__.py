"""Operators of a training-data pipeline: joins of similar texts, mixing,
quality, secrets, URL rules, tokenising, licences, archives, exact search.

Nothing else in the library imports this package.
"""
