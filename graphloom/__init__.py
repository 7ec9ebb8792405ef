"""graphloom: property-graph queries and record processing on Spark DataFrames."""
