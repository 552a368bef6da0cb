"""Reading the source relations and sheets; reading and writing ledgers and rule tables."""
