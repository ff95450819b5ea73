"""tidewire: event analytics and corpus preparation as plain PySpark jobs."""
