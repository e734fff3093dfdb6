"""Plans built step by step."""
