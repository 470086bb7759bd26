"""A graph analytics engine on Spark: graph queries become one lazy DataFrame."""
