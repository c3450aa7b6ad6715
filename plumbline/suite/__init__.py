"""The registered queries: each operator over the test tables, with the SQL of the same rows."""

MODULES = ("numeric", "categorical", "temporal", "dataset", "quality", "compare", "schema", "sketches", "describe", "sources")
