"""Column-to-column functions; everything here stays in the JVM."""
