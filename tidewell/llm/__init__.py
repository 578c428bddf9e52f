"""Training-data operators: packing, filtering, scanning, counting, dedup, mixing.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library intact.
"""
