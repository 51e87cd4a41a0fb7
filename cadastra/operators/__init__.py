"""Table operators: spatial joins, state collapse, windows, graph and statistics."""
