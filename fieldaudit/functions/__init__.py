"""Column expressions: geometry, statistics, hashing and text.  All run inside Spark's codegen."""
