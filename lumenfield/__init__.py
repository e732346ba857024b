"""lumenfield: hyperspectral cube analytics and large-table operators on PySpark."""
