"""partita."""
