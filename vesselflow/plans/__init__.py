"""The user-level analyses and jobs."""
