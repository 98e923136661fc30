"""A Spark engine for lineage graphs and the tables around them."""
