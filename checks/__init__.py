"""Driver tables mapped to the domain, registered queries and their SQL counterparts."""
