"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query
``opN_<name>`` per operator; each operator module has its own general interface.
"""
