"""Sources: declared-schema raw reads, the retail view over the test tables, layer reads."""

from tillroll.sources.raw import declared_read, read_layer, read_star_tables, read_table
from tillroll.sources.retail import retail_raw

__all__ = ["declared_read", "read_layer", "read_star_tables", "read_table", "retail_raw"]
