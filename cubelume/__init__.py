"""A PySpark-native engine for space-time colour cubes and scored event batches."""
