"""driftframe: particle-trajectory analytics on Spark DataFrames."""
