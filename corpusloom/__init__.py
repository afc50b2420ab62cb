"""Document retrieval, agent-trace analytics and corpus preparation on Spark DataFrames."""
