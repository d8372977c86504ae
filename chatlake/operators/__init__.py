"""chatlake operators."""
