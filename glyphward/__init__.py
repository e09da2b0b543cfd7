"""Unicode confusable and identifier analytics on Spark DataFrames (UTS #39, UAX #15, UAX #24, UAX #31)."""
