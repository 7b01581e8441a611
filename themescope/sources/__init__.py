"""Sources and sinks: landed search pages, post/vector/clustered tables."""
