"""Monthly product-sales analytics and forecasting as Spark DataFrame jobs."""
