"""Where rows come from: page files, page tables, stored reports, ledgers, price lists."""
