"""DataFrame-to-DataFrame operators; no state, no actions but stated guards."""
