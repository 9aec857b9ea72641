"""Training-data operators: deduplication, filtering, decontamination, packing and file formats.

Nothing outside this subpackage imports it.  Each operator has its own module
with a general interface; ``queries.py`` binds them to the standard tables.
"""
