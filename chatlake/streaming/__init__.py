"""chatlake streaming."""
