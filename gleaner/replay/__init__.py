"""Games and solution lines replayed move by move: the one part that is sequential by nature."""
