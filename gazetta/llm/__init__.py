"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; `__spark_entry__.py` registers its
queries only where the subpackage is present.
"""
