"""Column functions: everything here is an expression that Spark runs in the JVM."""
