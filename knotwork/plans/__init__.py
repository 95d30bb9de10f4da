"""Planning helpers: positions, pair functions, run metrics."""
