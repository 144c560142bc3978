"""Multi-step jobs: loading, fitness, selection, tournament, full run."""
