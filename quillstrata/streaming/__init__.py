"""The row-wise stages over unbounded input."""
