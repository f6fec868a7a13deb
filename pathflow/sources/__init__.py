"""Readers that give the canonical link, route, demand and performance tables."""
