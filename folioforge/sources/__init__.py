"""sources of folioforge."""
