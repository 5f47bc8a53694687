"""An extension: Structured Streaming into tables.  The dialect itself has no streaming statement."""
