"""Account health and contract-renewal risk as Spark DataFrame jobs."""
