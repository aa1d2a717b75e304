"""quarrylight: code, security and corpus analytics as Spark DataFrame jobs."""
