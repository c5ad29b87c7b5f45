"""graphloom: property-graph and machine-learning operators as PySpark plans."""
