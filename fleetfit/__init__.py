"""fleetfit: capacity rightsizing analytics as Spark DataFrame transforms."""
