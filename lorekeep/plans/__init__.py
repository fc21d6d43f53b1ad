"""Query builders, the engine facade, the registered queries and the command line."""
