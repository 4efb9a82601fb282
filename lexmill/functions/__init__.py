"""Column functions. They take and give columns, and run inside the JVM."""
