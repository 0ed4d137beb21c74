"""Field-image and job-telemetry analytics as Spark DataFrame operators."""
