"""Where rows come from: line files, log adapters, growing files, synthetic logs."""
