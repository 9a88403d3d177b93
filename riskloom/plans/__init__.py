"""Query registry, oracle SQL and end-to-end plans (training, scoring)."""
