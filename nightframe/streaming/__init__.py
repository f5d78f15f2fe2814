"""The solve log as a stream."""
