"""Declarative plans: queries as text that Catalyst plans, with the same text for the check in another engine."""
