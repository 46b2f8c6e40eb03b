"""Operators on texts and messages for training data. Nothing else in the package imports this one."""
