"""operators of folioforge."""
