"""Content-based matching, ranking and catalog maintenance on Apache Spark."""
