"""Plans that chain operators: pass configuration and the reconciliation of runs."""
