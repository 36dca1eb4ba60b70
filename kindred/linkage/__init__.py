"""Probabilistic record linkage (Fellegi & Sunter 1969) within one table or across two."""
