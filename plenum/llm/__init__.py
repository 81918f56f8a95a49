"""Training-data operators. Nothing outside this subpackage (and its entry points) imports it."""
