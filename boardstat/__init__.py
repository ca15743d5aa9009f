"""boardstat: licensure-examination analytics as Spark DataFrame jobs."""
