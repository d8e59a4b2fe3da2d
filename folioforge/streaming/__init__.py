"""streaming of folioforge."""
