"""barlake: daily price bars from raw files to ranked signals, as Spark jobs."""
