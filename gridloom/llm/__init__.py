"""Training-data operators: dedup, decontamination, filtering, sharding, packing, counting.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` and ``oracles`` hold the registered queries and their SQL.
"""
