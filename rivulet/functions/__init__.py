"""Column-level functions: views of a value, regex dialect, cards, profiles."""
