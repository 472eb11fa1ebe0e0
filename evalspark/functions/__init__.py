"""Column functions: text in, Column out, evaluated inside the JVM."""
