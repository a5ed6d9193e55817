"""Where rows go, and what survives a crash or a fork there."""
