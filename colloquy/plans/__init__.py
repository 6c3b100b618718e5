"""Plans: the library of questions, over the built tables."""
