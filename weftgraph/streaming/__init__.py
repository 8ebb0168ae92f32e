"""Keeping graph figures up to date as edge files arrive."""
