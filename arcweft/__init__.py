"""arcweft: a property-graph and dataset analytics engine written for Spark's DataFrame API."""
