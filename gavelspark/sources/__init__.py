from gavelspark.sources.mapped import AuctionData
from gavelspark.sources.tables import SCHEMAS, read_jdbc, read_table, register_views, write_table

__all__ = ["AuctionData", "SCHEMAS", "read_jdbc", "read_table", "register_views", "write_table"]
