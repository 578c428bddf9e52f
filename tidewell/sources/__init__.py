"""Sources: event lines, and the star-schema tables read as notes."""
