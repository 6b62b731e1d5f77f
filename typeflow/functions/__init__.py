"""Column expressions and small value helpers. Everything here stays in the JVM: no Python UDFs."""
