"""Intentionally empty: the workload is batch only (see README, "Scope")."""
