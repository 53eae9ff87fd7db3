"""Event-log, read-model and risk analytics as DataFrame-to-DataFrame operators on Spark."""
