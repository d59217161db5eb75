"""Following a run while it goes on."""
