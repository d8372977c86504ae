"""chatlake functions."""
