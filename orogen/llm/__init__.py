"""Operators for preparing training data at cluster scale.

Nothing outside this subpackage imports it; ``queries.py`` registers the
``opN_*`` queries that ``__spark_entry__.py`` adds when it can be imported.
"""
