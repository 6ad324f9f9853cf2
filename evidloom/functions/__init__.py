"""Column functions: scalar operations as expressions that stay on the JVM."""
