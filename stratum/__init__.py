"""Typed, primary-keyed, versioned tables on Spark."""
