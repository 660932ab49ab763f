"""Training-data operators: one module per operator, registered as queries in ``pricemill.llm.queries``."""
