"""Training-data forensics on Spark: cleaning, curve scoring, detection, removal and metrics."""
