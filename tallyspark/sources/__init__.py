"""Where rows come from and go to: files, versions, JDBC, generated orders."""
