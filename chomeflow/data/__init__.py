"""Registry data that comes with the package."""
