"""Plans: whole computations composed of operators."""
