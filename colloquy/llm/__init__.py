"""Operators that prepare text for training large language models.

Nothing outside this subpackage imports it; the driver entry adds its queries only if it is there.
"""
