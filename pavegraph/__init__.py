"""Places and aerial tiles to vector maps and walkable networks, as DataFrame operators."""
