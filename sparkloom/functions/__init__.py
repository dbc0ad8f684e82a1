"""Column expressions: everything here stays inside the JVM."""
