"""DataFrame operators. Every operator takes and returns lazy ``DataFrame``s."""
