"""Spark-native analytics for cohorts of volumetric scans and the tables around them."""
