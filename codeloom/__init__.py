"""codeloom: a PySpark-native analytics engine over code-index tables.

The core subpackages (``operators``, ``sources``, ``functions``, ``plans``,
``streaming``) never import :mod:`codeloom.llm`; that subpackage may use them.
"""
