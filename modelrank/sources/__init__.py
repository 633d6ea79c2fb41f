"""Tables, datasets and where they are kept."""
