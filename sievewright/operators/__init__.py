"""Relational operators built from DataFrame plans and the Arrow scan kernel."""
