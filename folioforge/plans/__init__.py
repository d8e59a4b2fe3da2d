"""plans of folioforge."""
