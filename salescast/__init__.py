"""Sales forecasting for products whose prices change, as Spark jobs."""
