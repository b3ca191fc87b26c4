"""Reading, shaping and storing of tables."""
