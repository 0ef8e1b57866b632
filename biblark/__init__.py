"""Analytics for personal research libraries on Spark: catalogue, retrieval, graphs, bibliography, streams."""
