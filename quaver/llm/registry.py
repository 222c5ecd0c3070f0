"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from quaver.llm import queries

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op")}
ORACLES = {"op3_bit_sliced_top_k": queries.OP3_SQL, "op10_chat_format": queries.OP10_SQL, "op11_merkle_manifest": queries.OP11_SQL, "op13_source_divergence": queries.OP13_SQL}
