"""Operators that prepare text for language-model training, each a Spark job of its own.

Nothing outside this subpackage imports it. Every module holds one operator with a general
interface and the thin ``query`` that ``__spark_entry__.py`` registers under ``opN_<name>``.
"""
