"""Writers of decks, tables and documents."""
