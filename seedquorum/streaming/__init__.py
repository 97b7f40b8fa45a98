"""Live counterparts of batch aggregates."""
