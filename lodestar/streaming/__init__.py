"""The same operators over growing sources."""
