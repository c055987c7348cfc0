"""The registered queries: the library run over the driver's tables, each with an independent SQL twin."""
