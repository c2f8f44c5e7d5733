"""Where rows come from: sample rows, the generator, and stored tables."""
