"""A stand-in for the imaging library: a picture keeps its content whatever is done to it."""
