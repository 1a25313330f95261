"""Part of the market analytics library."""
