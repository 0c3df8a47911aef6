"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; :mod:`vestry.llm.queries` holds the thin
``opN_<name>`` queries with production parameters.
"""
