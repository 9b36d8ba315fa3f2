"""Set-oriented operators over claims, lines, documents and findings."""
