"""Operators for preparing text collections at scale.

The subpackage is self-contained: nothing else in the library imports it, and
its queries live in :mod:`quillmesh.llm.queries`.
"""
