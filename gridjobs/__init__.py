"""Ready-made Spark jobs for location and table analytics."""
