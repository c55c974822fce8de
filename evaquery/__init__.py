"""evaquery: indoor-space and evacuation analytics on Apache Spark."""
