"""Text, event-journey and scored-document analytics built on Spark DataFrames."""
