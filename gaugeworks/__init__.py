"""Manufacturing-quality analytics as composable Spark DataFrame functions."""
