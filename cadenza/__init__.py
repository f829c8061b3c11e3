"""cadenza: catalogue-scale music analytics and corpus preparation on Spark."""
