"""Control plane: tools, the JSON-RPC server, the command line. No data volume passes through it."""
