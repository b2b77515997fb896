"""Column functions: projections, predicates and scalar expressions, all inside Catalyst."""
