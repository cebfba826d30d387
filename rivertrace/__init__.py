"""River water-quality monitoring and pollution-source attribution on Spark."""
