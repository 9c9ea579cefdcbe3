"""Training-data operators: mixing, quality, chat, dedup, sharding, tokenizing, joins, language, secrets, HTML."""
