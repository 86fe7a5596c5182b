"""Training-data operators: each is one module; ``queries`` registers them."""
