"""Relational operators: rules, decisions, selection, similarity, activity, state."""
