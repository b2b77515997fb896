"""Operators over entity-keyed tables. Each takes and returns DataFrames; the entity key is a parameter and the
partition key of nearly every window, so one series or millions run by the same plan."""
