"""Rule packs: vocabularies and patterns, kept as data."""
