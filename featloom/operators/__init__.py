"""Feature operators and the distributed primitives below them."""
