"""chatlake sources."""
