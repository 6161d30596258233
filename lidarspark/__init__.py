"""Spark-first analytics for airborne LiDAR point clouds."""
