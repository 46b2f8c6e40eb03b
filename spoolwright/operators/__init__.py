"""Operators over DataFrames: each declares a plan and leaves the physical strategy to Catalyst."""
