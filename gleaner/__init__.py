"""gleaner: find, in a very large table, the rows a user cares about from a few 0/1 labels."""
