"""Column-to-column expressions; every one stays inside the JVM."""
