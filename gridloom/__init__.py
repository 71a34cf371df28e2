"""gridloom: data work for machine learning, expressed as Spark DataFrame jobs."""
