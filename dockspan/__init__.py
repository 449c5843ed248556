"""dockspan: structure-based compound screening as Spark DataFrame jobs."""
