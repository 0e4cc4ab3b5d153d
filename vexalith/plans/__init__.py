"""Statements: syntax trees, the parser, and the planner that turns them into DataFrames."""
