"""Scalar functions. All stay on the JVM except those that name Arrow in their docstring."""
