"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage.  ``roadspark.llm.queries``
holds the registered queries and their SQL.
"""
