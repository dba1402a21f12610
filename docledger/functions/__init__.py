"""Column-to-column functions; all run JVM-side unless a docstring says otherwise."""
