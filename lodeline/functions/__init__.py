"""Column expressions. Every function takes and returns ``Column``s and stays in the JVM."""
