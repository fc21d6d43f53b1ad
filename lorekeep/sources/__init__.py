"""Tables, stores, exports and generated data."""
