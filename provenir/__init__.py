"""provenir: cited-knowledge analytics and training-data operators on Spark."""
