"""Label packs: plain keyword lists and label tables, data only."""
