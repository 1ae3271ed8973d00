"""Early warning from animal health reports, on Spark."""
