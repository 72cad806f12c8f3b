"""Catalogs, listings and stores."""
