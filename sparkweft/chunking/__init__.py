"""From readings to document units, section-aware blocks and retrieval chunks."""
