"""Plans over whole stores: the facade, the audit, the registered queries."""
