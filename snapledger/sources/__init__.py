"""Where rows come from: the ledger projection, JSON pages, statements, object stores."""
