"""The two jobs: mixed-frequency nowcast and twelve-month forecast."""
