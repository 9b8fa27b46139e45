"""Match analytics on Spark: declarative DataFrame operators over tracking and tag tables."""
