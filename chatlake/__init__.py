"""chatlake: chat-archive analytics as PySpark DataFrame operators."""
